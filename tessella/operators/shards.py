"""Shards, gaps and runs of dense indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .universe import number_rows


def _check(count: int, shard: int) -> None:
    if count < 1 or not 0 <= shard < count:
        raise ValueError(f"shard {shard} of {count}")


def modulo_shard(rows: DataFrame, count: int, shard: int, index: str = "sample_index") -> DataFrame:
    """Rows whose index is ``shard`` modulo ``count``: a filter on the scan."""
    _check(count, shard)
    return rows.where(F.pmod(F.col(index), F.lit(count)) == shard)


def nested_shard(ranks: int, rank: int, workers: int, worker: int) -> tuple[int, int]:
    """(count, shard) of a worker of a rank: flat number worker * ranks + rank."""
    _check(ranks, rank)
    _check(workers, worker)
    return ranks * workers, worker * ranks + rank


def runtime_shard(rows: DataFrame, count: int, shard: int, total: int, index: str = "sample_index") -> DataFrame:
    """As :func:`modulo_shard`, without the tail that would give some shards one row more."""
    return modulo_shard(rows, count, shard, index).where(F.col(index) < total // count * count)


def index_range(rows: DataFrame, start: int, stop: int, index: str = "sample_index") -> DataFrame:
    return rows.where((F.col(index) >= start) & (F.col(index) < stop))


def missing_indexes(spark: SparkSession, done: DataFrame, total: int, index: str = "sample_index") -> DataFrame:
    """Indexes 0 .. total - 1 that ``done`` lacks."""
    return spark.range(total).select(F.col("id").alias(index)).join(done.select(index), index, "left_anti")


def runs(rows: DataFrame, index: str, by: list[str] | None = None, bucket: int = 1 << 20) -> DataFrame:
    """(by, start, stop, count): maximal runs of consecutive indexes (stop is inclusive).

    Runs are found within buckets of the index range, in parallel, and joined across bucket borders on what is left.
    """
    by = by or []
    part = Window.partitionBy(*by, "__b").orderBy(index)
    marked = rows.select(*by, index).distinct().withColumn("__b", F.floor(F.col(index) / bucket)).withColumn("__g", F.col(index) - F.row_number().over(part))
    pieces = marked.groupBy(*by, "__b", "__g").agg(F.min(index).alias("start"), F.max(index).alias("stop"))
    at_border = (F.pmod("start", F.lit(bucket)) == 0) | (F.pmod(F.col("stop") + 1, F.lit(bucket)) == 0)  # at most two a bucket: all that can go on
    order = Window.partitionBy(*by).orderBy("start")
    fresh = (F.col("start") != F.lag("stop").over(order) + 1) | F.lag("stop").over(order).isNull()
    linked = pieces.where(at_border).withColumn("__f", fresh.cast("long")).withColumn("__r", F.sum("__f").over(order))
    joined = linked.groupBy(*by, "__r").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return pieces.where(~at_border).select(*by, "start", "stop").union(joined.select(*by, "start", "stop")).withColumn("count", F.col("stop") - F.col("start") + 1)


def steps(rows: DataFrame, index: str, by: list[str]) -> DataFrame:
    """(by, start, step, count): greedy arithmetic runs of the indexes of each group, in order; the last element of a run starts no other."""
    order = Window.partitionBy(*by).orderBy(index)
    gap = rows.select(*by, index).distinct().withColumn("__d", F.lead(index).over(order) - F.col(index)).withColumn("__new", F.coalesce((F.col("__d") != F.lag("__d").over(order)).cast("int"), F.lit(1)))
    runs_ = gap.withColumn("__r", F.sum("__new").over(order))
    return runs_.groupBy(*by, "__r").agg(F.min(index).alias("start"), F.coalesce(F.min("__d"), F.lit(1)).alias("step"), F.count("*").alias("count")).drop("__r")


def describe_runs(rows: DataFrame, index: str = "sample_index", limit: int = 10) -> str:
    """``0-3, 7, 9-10``, at most ``limit`` runs."""
    found = runs(rows, index).orderBy("start").limit(limit + 1).collect()
    text = ", ".join(str(r["start"]) if r["count"] == 1 else f"{r['start']}-{r['stop']}" for r in found[:limit])
    return text + ", ..." * (len(found) > limit)


def group_of(index: Column, size: int = 4096) -> Column:
    """Number of an index's shuffle group."""
    return F.floor(index / size).cast("long")


def shuffle_order(rows: DataFrame, seed: int, epoch: int, group: str = "group", index: str = "sample_index") -> list[Column]:
    """Sort keys of a deterministic shuffle: groups in random order, and their rows within them."""
    return [F.xxhash64(F.lit(seed), F.lit(epoch), F.col(group)), F.col(group), F.xxhash64(F.lit(seed), F.lit(epoch), F.col(group), F.col(index)), F.col(index)]


def shuffle_groups(groups: list[int], sizes: list[int], seed: int, epoch: int, replicas: int = 1, rank: int = 0) -> list[list[int]]:
    """Exact order of a seeded generator: shuffled groups of positions, each shuffled by a seed of its own; a rank takes every
    ``replicas``-th of the flattened positions."""
    import random

    _check(replicas, rank)
    rng, offsets, total = random.Random(seed + epoch), [], 0
    for n in sizes:
        offsets.append(total)
        total += n
    order = list(range(len(groups)))
    rng.shuffle(order)
    out, flat = [], 0
    for g in order:
        rows = list(range(offsets[g], offsets[g] + sizes[g]))
        random.Random(rng.getrandbits(64)).shuffle(rows)
        out.append([r for k, r in enumerate(rows, flat) if k % replicas == rank])
        flat += len(rows)
    return out


def rank_trim(rows: DataFrame, rank: Column, batch: Column, ranks: int | None = None) -> DataFrame:
    """Batches that every rank has: those beyond the shortest rank's go.

    ``ranks``: there should be the ranks 0 .. ranks - 1; if some have batches, one without any is an error, as every rank would end with none."""
    marked = rows.withColumn("__rank", rank).withColumn("__batch", batch)
    counts = marked.groupBy("__rank").agg((F.max("__batch") + 1).alias("__n"))
    if ranks is not None:
        have = {r[0] for r in counts.where(F.col("__rank").between(0, ranks - 1)).select("__rank").collect()}
        if have and (lost := sorted(set(range(ranks)) - have)):
            raise ValueError(f"ranks {lost} have no batch, others have")
    least = counts.agg(F.min("__n").alias("__least"))
    return marked.join(F.broadcast(least)).where("__batch < __least").drop("__rank", "__batch", "__least")


def next_accepted(rows: DataFrame, total: int, max_probe: int = 32, index: str = "sample_index", accepted: str = "accepted") -> DataFrame:
    """(index, served): itself where accepted, else the next accepted index within ``max_probe`` places, around the end; null if none.

    The probe window is bounded, so each block of the index range needs only the ``max_probe`` rows behind it.
    """
    block = 1 << 16
    probe = min(max_probe, max(total - 1, 0))
    i = F.col(index)
    wrap = rows.where(i < probe).select((i + total).alias(index), accepted, i.alias("__own"))
    doubled = rows.select(index, accepted, i.alias("__own")).union(wrap)
    spots = F.array_distinct(F.array(F.floor(i / block), F.floor(F.greatest(i - probe, F.lit(0)) / block)))
    placed = doubled.withColumn("__block", F.explode(spots))
    ahead = Window.partitionBy("__block").orderBy(index).rowsBetween(0, probe)
    served = F.first(F.when(F.col(accepted), F.col("__own")), ignorenulls=True).over(ahead)
    return placed.withColumn("served", served).where((i < total) & (F.col("__block") == F.floor(i / block))).select(index, accepted, "served")


def replace_rejected(rows: DataFrame, total: int, buffer_size: int = 64, min_buffer: int = 8, max_probe: int = 32, seed: int = 0, index: str = "sample_index", accepted: str = "accepted") -> DataFrame:
    """(index, accepted, served) of every row: as :func:`next_accepted`, and where no neighbour will do, one of the ``buffer_size`` accepted rows
    before it, picked by ``seed``; an error if fewer than ``min_buffer`` came before (a cold start).

    The buffer of a sequential reader is the newest accepted rows, so a row's number among them, which prefix sums give, finds it by an equi-join.
    """
    i, picked = F.col(index), F.col(accepted)
    numbered = prefix_sums(rows.select(index, accepted).withColumn("__one", picked.cast("long")), index, "__one", "__no").drop("__one")
    known = next_accepted(rows, total, max_probe, index, accepted)
    lost = known.where("served is null").drop("served").join(numbered.select(index, "__no"), index)
    back = F.pmod(i * 2654435761 + seed, F.least("__no", F.lit(buffer_size)))
    cold = F.raise_error(F.concat(F.lit("no accepted row near or before row "), i.cast("string")))
    lost = lost.withColumn("__at", F.when(F.col("__no") >= min_buffer, F.col("__no") - 1 - back).otherwise(cold.cast("long")))
    buffer = numbered.where(picked).select(F.col("__no").alias("__at"), i.alias("served"))
    return known.where("served is not null").union(lost.join(buffer, "__at").select(index, accepted, "served"))


def reject_alerts(rows: DataFrame, warn: float = 0.05, maximum: float = 0.2, window: int = 200, index: str = "sample_index", accepted: str = "accepted") -> DataFrame:
    """(index, reject_ratio, level): rejected rows at which the ratio over a full window is at least ``warn`` (level ``warn``) or ``maximum`` (``error``)."""
    if not 0 <= warn <= maximum <= 1:
        raise ValueError("warn and maximum must be ratios, warn not above maximum")
    ratio = rolling_reject_ratio(rows, window, index, accepted).where(F.col(index) >= window - 1)
    level = F.when(F.col("reject_ratio") >= maximum, "error").when(F.col("reject_ratio") >= warn, "warn")
    return ratio.join(rows.where(~F.col(accepted)).select(index), index).withColumn("level", level).where("level is not null")


def rolling_reject_ratio(rows: DataFrame, window: int = 200, index: str = "sample_index", accepted: str = "accepted") -> DataFrame:
    """(index, reject_ratio) over the last ``window`` rows, in blocks that overlap by the window."""
    block = 1 << 16
    i = F.col(index)
    spots = F.array_distinct(F.array(F.floor(i / block), F.floor((i + window - 1) / block)))
    behind = Window.partitionBy("__block").orderBy(index).rowsBetween(-(window - 1), 0)
    ratio = F.avg(F.when(F.col(accepted), 0.0).otherwise(1.0)).over(behind)
    return rows.withColumn("__block", F.explode(spots)).withColumn("reject_ratio", ratio).where(F.col("__block") == F.floor(i / block)).select(index, "reject_ratio")


def guard_reject_ratio(rows: DataFrame, maximum: float = 0.2, window: int = 200, index: str = "sample_index", accepted: str = "accepted") -> None:
    """Raises at the first index with a full window whose reject ratio is at least ``maximum``."""
    bad = rolling_reject_ratio(rows, window, index, accepted).where((F.col(index) >= window - 1) & (F.col("reject_ratio") >= maximum)).agg(F.min(index)).first()[0]
    if bad is not None:
        raise RuntimeError(f"too many rejected rows before index {bad}; filter first instead")


def selected_groups(positions: DataFrame, seed: int, epoch: int, replicas: int = 1, rank: int = 0, size: int = 4096) -> DataFrame:
    """(group_order, group, rank_order, position, sample_index): the shuffle groups of a universe carried over to the positions of a selection.

    ``positions`` has (sample_index, position) of the selected samples.  Groups come in their shuffled order, rows in theirs; a rank has every
    ``replicas``-th of the flattened rows.  Only the groups, which are few, are ordered as a whole; rows are ordered within their group.
    """
    _check(replicas, rank)
    rows = positions.select("sample_index", "position", group_of(F.col("sample_index"), size).alias("group"))
    group_key, row_key = F.xxhash64(F.lit(seed), F.lit(epoch), F.col("group")), F.xxhash64(F.lit(seed), F.lit(epoch), F.col("group"), F.col("sample_index"))
    counts = number_rows(rows.groupBy("group").agg(F.count("*").alias("__n")).withColumn("__key", group_key), ["__key", "group"], "group_order")
    offsets = prefix_sums(counts, "group_order", "__n", "__before").select("group", "group_order", "__before")
    within = F.row_number().over(Window.partitionBy("group").orderBy(row_key, "sample_index")) - 1
    placed = rows.withColumn("__k", within).join(offsets, "group").withColumn("__flat", F.col("__before") + F.col("__k"))
    mine = placed.where(F.pmod("__flat", F.lit(replicas)) == rank)
    return mine.select("group_order", "group", F.col("__flat").alias("rank_order"), "position", "sample_index")


def prefix_sums(rows: DataFrame, index: str, value: str, name: str = "before", block: int = 1 << 16) -> DataFrame:
    """``rows`` with the sum of ``value`` over all smaller values of the dense ``index``: blocks are summed first, and each on its own."""
    blocks = rows.groupBy(F.floor(F.col(index) / block).alias("__b")).agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("__b", before.alias("__start"))  # one row for each ``block`` rows
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__b").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__b", F.floor(F.col(index) / block)).withColumn("__in", inside).join(starts, "__b").withColumn(name, F.col("__start") + F.col("__in")).drop("__b", "__in", "__start")


def check_shard_output(rows: DataFrame, shards: int, shard: int, total: int | None = None, index: str = "sample_index") -> int:
    """Number of rows of one shard's output; raises unless its indexes are shard, shard + shards, .. each once, all of them below ``total`` if that is known."""
    _check(shards, shard)
    i = F.col(index)
    n, distinct, wrong, high = rows.agg(F.count("*"), F.countDistinct(index), F.count_if(i.isNull() | (F.pmod(i, F.lit(shards)) != shard) | (i < 0)), F.max(index)).first()
    expected = n if total is None else max(0, -(-(total - shard) // shards))
    if wrong or distinct != n or n != expected or (n and high != shard + (n - 1) * shards):
        raise ValueError(f"shard {shard} of {shards}: {n} rows for {expected}, {distinct} distinct, {wrong} of other shards, up to {high}")
    return n


def worker_summary(stats: DataFrame, operation: str = "filter") -> DataFrame:
    """One row of sums, extremes and rates over rows (samples, calls, seconds, batch_size_min, batch_size_max, elapsed_seconds) of workers."""
    mean = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    return stats.agg(
        F.count("*").alias("worker_count"),
        *(F.sum(c).alias(f"{operation}_{c}") for c in ("samples", "calls", "seconds")),
        F.min("batch_size_min").alias("batch_size_min"),
        F.max("batch_size_max").alias("batch_size_max"),
        mean("samples", "calls").alias("batch_size_mean"),
        mean("samples", "seconds").alias(f"{operation}_samples_per_second"),
        F.sum("elapsed_seconds").alias("elapsed_seconds_sum"),
        F.max("elapsed_seconds").alias("elapsed_seconds_max"),
    )
