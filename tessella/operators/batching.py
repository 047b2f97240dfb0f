"""Cost-bounded batches and padded collation.

Planning is sequential within a group of samples, so it runs as one pandas function a group; groups (a shard, a rank, an index block)
run in parallel.  Collation is array expressions over the planned batches.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A


@dataclass(frozen=True)
class Plan:
    max_batch_memory: int
    planning_window: int = 256
    max_batch_samples: int | None = None
    max_padding_ratio: float = 0.2

    def __post_init__(self):
        for name in ("max_batch_memory", "planning_window"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a positive integer")
        if self.max_batch_samples is not None and self.max_batch_samples < 1:
            raise ValueError("max_batch_samples must be positive")


def _choose(costs: np.ndarray, arrivals: np.ndarray, p: Plan) -> tuple[int, int]:
    """Range [start, stop] of the waiting samples, in order of (cost, arrival), that the next batch takes.

    Ranges of two or more whose padding is within the limit win by total cost; if none is, the one of least padding; if no two fit,
    the most expensive sample that fits.  Ties: less padding (or more cost), the oldest sample, the first range.
    """
    sums = [0, *np.cumsum(costs).tolist()]
    least = p.max_batch_samples or len(costs)

    def padding(start: int, stop: int) -> float:
        padded = int(costs[stop]) * (stop - start + 1)
        return (padded - (sums[stop + 1] - sums[start])) / padded if padded else 0.0

    def widest(start: int, stop: int, limit: float) -> int:
        """First start whose padding is within the limit; it shrinks as the start moves right."""
        return bisect.bisect_left(range(stop - 1), True, lo=start, key=lambda k: padding(k, stop) <= limit) if start < stop - 1 else start

    def oldest(start: int, stop: int) -> int:
        return int(arrivals[start : stop + 1].min())

    close, loose = None, None
    for stop in range(1, len(costs)):
        start = max(bisect.bisect_left(sums, sums[stop + 1] - p.max_batch_memory, 0, stop), stop - least + 1)
        if start >= stop:
            continue
        pair = padding(stop - 1, stop)
        fits = pair <= p.max_padding_ratio
        if not fits and close is not None:
            continue
        first = widest(start, stop, p.max_padding_ratio if fits else pair)
        total, share = sums[stop + 1] - sums[first], padding(first, stop)
        rank = ((total, -share) if fits else (-share, total)) + (-oldest(first, stop), -first, -stop)
        if fits:
            close = max(close, (rank, first, stop)) if close else (rank, first, stop)
        else:
            loose = max(loose, (rank, first, stop)) if loose else (rank, first, stop)
    if best := close or loose:
        return best[1], best[2]
    fitting = bisect.bisect_right(costs.tolist(), p.max_batch_memory) - 1
    start = bisect.bisect_left(costs.tolist(), int(costs[fitting]))
    at = start + int(arrivals[start : fitting + 1].argmin())
    return at, at


def plan_costs(costs: list[int], p: Plan) -> list[list[int]]:
    """Batches of positions: greedy, with a bounded look-ahead; rows of a batch are in order of arrival."""
    if any(isinstance(c, bool) or c < 1 for c in costs):
        raise ValueError("costs must be positive integers")
    window = 1 if p.max_batch_samples == 1 else p.planning_window
    waiting: list[tuple[int, int]] = []  # (cost, arrival), sorted
    out, fed = [], 0
    while True:
        while len(waiting) < window and fed < len(costs):
            bisect.insort(waiting, (int(costs[fed]), fed))
            fed += 1
        if not waiting:
            return out
        cost, arrival = min(waiting, key=lambda x: x[1])
        if cost > p.max_batch_memory:
            raise ValueError(f"sample {arrival} costs {cost}, more than a batch may ({p.max_batch_memory})")
        a, b = _choose(np.array([c for c, _ in waiting], np.int64), np.array([k for _, k in waiting], np.int64), p)
        out.append(sorted(k for _, k in waiting[a : b + 1]))
        del waiting[a : b + 1]


def plan_batches(rows: DataFrame, cost: Column, p: Plan, group: Column | None = None, index: str = "sample_index") -> DataFrame:
    """(group, batch, position, index, cost): batches of each group, planned over its samples in index order."""
    ready = rows.select((group if group is not None else F.lit(0)).cast("long").alias("group"), F.col(index).cast("long").alias(index), cost.cast("long").alias("cost"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(index)
        names, costs = part[index].to_numpy(), part["cost"].tolist()
        taken = [(k, n, i) for k, batch in enumerate(plan_costs(costs, p)) for n, i in enumerate(batch)]
        return pd.DataFrame({"group": part["group"].iloc[0], "batch": [k for k, _, _ in taken], "position": [n for _, n, _ in taken], index: [names[i] for _, _, i in taken], "cost": [costs[i] for _, _, i in taken]})

    return ready.groupBy("group").applyInPandas(run, f"group long, batch long, position long, {index} long, cost long")


def unit_batches(rows: DataFrame, p: Plan, group: Column, index: str = "sample_index") -> DataFrame:
    """The same for unit costs, where the plan has a closed form: every batch takes the oldest rows."""
    size = min(p.max_batch_memory, p.planning_window, p.max_batch_samples or p.max_batch_memory)
    place = F.row_number().over(Window.partitionBy("group").orderBy(index)) - 1
    ready = rows.select(group.cast("long").alias("group"), F.col(index).cast("long").alias(index)).withColumn("__k", place)
    return ready.select("group", F.floor(F.col("__k") / size).cast("long").alias("batch"), (F.col("__k") % size).cast("long").alias("position"), index)


def batch_summary(planned: DataFrame) -> DataFrame:
    by = planned.groupBy("group", "batch").agg(F.count("*").alias("samples"), F.sum("cost").alias("cost"), F.max("cost").alias("largest"))
    return by.select("group", "batch", "samples", "cost", A.padding_ratio(F.col("cost"), F.col("largest"), F.col("samples")).alias("padding_ratio"))


def collate_arrays(rows: DataFrame, by: list[str], order: str, values: str, fill: Column) -> DataFrame:
    """(by, values, mask, lengths): arrays of a batch padded to its longest, with true where a value is real."""
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, values))).alias("__s")).withColumn("__v", F.transform("__s", lambda x: x[values]))
    longest = F.array_max(F.transform("__v", F.size))
    out = packed.withColumn("__l", longest)
    return out.select(
        *by,
        F.transform("__v", lambda v: A.pad(v, F.col("__l"), fill)).alias(values),
        F.transform("__v", lambda v: A.pad_mask(v, F.col("__l"))).alias("mask"),
        F.transform("__v", lambda v: F.size(v).cast("long")).alias("lengths"),
    )


def collate_waveforms(rows: DataFrame, by: list[str], order: str, wave: str) -> DataFrame:
    """(by, data, rates, mask): waveforms [channel][time] of a batch padded in time; all must have the same number of channels."""
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(f"{wave}.data").alias("d"), F.col(f"{wave}.sample_rate").alias("r")))).alias("__s"))
    waves = F.transform("__s", lambda x: x["d"])
    times = F.transform(waves, lambda w: F.size(w[0]))
    out = packed.withColumn("__w", A.fixed_shape(waves)).withColumn("__l", F.array_max(times))
    return out.select(*by, F.transform("__w", lambda w: A.pad_channels(w, F.col("__l"))).alias("data"), F.transform("__s", lambda x: x["r"]).alias("rates"), F.transform("__w", lambda w: A.pad_mask(w[0], F.col("__l"))).alias("mask"))


def collate_codes(rows: DataFrame, by: list[str], order: str, codes: str) -> DataFrame:
    """(by, codes, mask): frame codes [frame][codebook] of a batch padded in frames."""
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, codes))).alias("__s")).withColumn("__c", F.transform("__s", lambda x: x[codes]))
    out = packed.withColumn("__l", F.array_max(F.transform("__c", F.size)))
    return out.select(*by, F.transform("__c", lambda c: A.pad_frames(c, F.col("__l"))).alias(codes), F.transform("__c", lambda c: A.pad_mask(c, F.col("__l"))).alias("mask"))
