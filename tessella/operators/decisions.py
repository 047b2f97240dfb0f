"""Filter rules with immutable, published decisions.

A rule's decisions over a whole universe are one *generation*: Parquet partitioned by label, with metrics, a count for each label and a manifest.
A pointer file names the current generation; readers hold a lease on what they read, and cleaning up spares it.  Bounded runs publish
windows of the index range as segments; a reader loads the longest prefix.
"""

from __future__ import annotations

import json
import math
import os
import shutil
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.files import lock, write_json
from . import universe as U


def normalize_label(value: object) -> str:
    """True accepts, False rejects; enums by value, then name; anything else must be a non-empty string."""
    if value is True or value is False:
        return ("reject", "accept")[value]
    label = value if not isinstance(value, Enum) else value.value if isinstance(value.value, str) else value.name
    if isinstance(label, str) and label:
        return label
    raise ValueError(f"{value!r} names no label")


def label_of(value: Column, kind: str) -> Column:
    """The same for a column of booleans or strings; empty or null is an error."""
    text = F.when(value, "accept").otherwise("reject") if kind == "boolean" else value
    return F.when(value.isNotNull() & (text != ""), text).otherwise(F.raise_error(F.lit("every sample needs a label")))


def unique_labels(*labels: object) -> list[str]:
    return list(dict.fromkeys(map(normalize_label, labels)))


def check_metrics(value: object) -> object:
    """JSON only: string keys, finite numbers."""
    if isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str):
                raise TypeError("metric names must be strings")
            check_metrics(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            check_metrics(v)
    elif isinstance(value, float) and not math.isfinite(value):
        raise ValueError("metrics must be finite")
    elif not (value is None or isinstance(value, (str, bool, int, float))):
        raise TypeError(f"not JSON: {type(value).__name__}")
    return value


@dataclass(frozen=True)
class Report:
    counts: dict[str, int]
    lookup_s: float
    build_s: float
    read_s: float
    reused: bool

    @property
    def rate(self) -> float:
        return sum(self.counts.values()) / self.build_s if self.build_s else 0.0


@dataclass(frozen=True, eq=True)
class FilterRule:
    """A named decision over samples.  ``decide`` adds the columns ``label`` and, if it likes, a struct ``metrics``."""

    name: str
    decide: Callable[[DataFrame], DataFrame]
    rule_id: str = ""
    version: str = "1"
    content_id: str = ""

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, FilterRule) and self.key == other.key

    @property
    def key(self) -> str:
        if not self.name:
            raise ValueError("a rule needs a name")
        return U.identity("rule", name=self.name, rule=self.rule_id or None, version=self.version, content=self.content_id or None)

    def decisions(self, samples: DataFrame) -> DataFrame:
        """(sample_index, label, metrics JSON or null): one row for each sample."""
        out = self.decide(samples)
        kind = dict(out.dtypes)["label"]
        metrics = F.to_json("metrics") if "metrics" in out.columns else F.lit(None).cast("string")
        return out.select("sample_index", label_of(F.col("label"), kind).alias("label"), metrics.alias("metrics"))

    # -- whole universes ------------------------------------------------------------------------

    def home(self, root: str, universe: U.Universe) -> Path:
        return Path(root, U.identity("filter", universe=universe.identity, rule=self.key))

    def apply(self, universe: U.Universe, root: str, refresh: bool = False) -> Filtered:
        return self.apply_with_report(universe, root, refresh)[0]

    def apply_with_report(self, universe: U.Universe, root: str, refresh: bool = False) -> tuple[Filtered, Report]:
        """Decisions over the whole universe, made once and reused by identity."""
        t0, home = time.monotonic(), self.home(root, universe)
        current = None if refresh else ready(home)
        t1, reused = time.monotonic(), current is not None
        if current is None:
            with lock(home / "lock"):
                current = None if refresh else ready(home)
                if current is None:
                    current = publish(home, self.decisions(universe.rows))
        t2 = time.monotonic()
        filtered = Filtered(universe, current)
        counts = filtered.counts()
        return filtered, Report(counts, t1 - t0, 0.0 if reused else t2 - t1, time.monotonic() - t2, reused)


def publish(home: Path, decisions: DataFrame) -> Path:
    """Write one immutable generation and point to it."""
    generation = home / f"generation-{uuid.uuid4().hex}"
    decisions.write.partitionBy("label").parquet(str(generation / "decisions"))
    written = decisions.sparkSession.read.parquet(str(generation / "decisions")) if any((generation / "decisions").glob("label=*")) else None
    counts = {r["label"]: r["count"] for r in written.groupBy("label").count().collect()} if written is not None else {}
    if written is not None:
        U.check_dense(written)
    write_json(generation / "manifest.json", {"counts": counts, "total": sum(counts.values())})
    write_json(home / "current.json", {"generation": generation.name})
    return generation


def ready(home: Path) -> Path | None:
    return None if why_not_ready(home) else home / json.loads((home / "current.json").read_text())["generation"]


def why_not_ready(home: Path) -> str | None:
    """Why there are no published decisions to read, or None."""
    if not (home / "current.json").exists():
        return "nothing is published"
    generation = home / json.loads((home / "current.json").read_text())["generation"]
    if not (generation / "manifest.json").exists():
        return f"{generation.name} has no manifest"
    manifest = json.loads((generation / "manifest.json").read_text())
    if lost := [x for x in manifest["counts"] if not (generation / "decisions" / f"label={x}").is_dir()]:
        return f"{generation.name} lacks the files of {lost}"
    if manifest["total"] != sum(manifest["counts"].values()):
        return f"{generation.name} has wrong counts"
    return None


class Lease:
    """Keeps a generation from being cleaned up."""

    def __init__(self, generation: Path):
        self.path = generation / f"lease-{os.getpid()}-{uuid.uuid4().hex}"
        self.path.touch()

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_: object) -> None:
        self.path.unlink(missing_ok=True)


def clean_up(home: Path) -> list[str]:
    """Drop generations that are neither current nor leased."""
    current = ready(home)
    gone = [g for g in home.glob("generation-*") if g != current and not any(g.glob("lease-*"))]
    for g in gone:
        shutil.rmtree(g)
    return sorted(g.name for g in gone)


@dataclass(frozen=True)
class Filtered:
    """A universe with published decisions; filtering it again starts from the universe, not from a selection."""

    universe: U.Universe
    generation: Path

    def decisions(self) -> DataFrame:
        spark = self.universe.rows.sparkSession
        if not any((self.generation / "decisions").glob("label=*")):
            return spark.createDataFrame([], "sample_index long, metrics string, label string")
        return spark.read.schema("sample_index long, metrics string, label string").parquet(str(self.generation / "decisions"))

    def counts(self) -> dict[str, int]:
        return json.loads((self.generation / "manifest.json").read_text())["counts"]

    def labels(self) -> list[str]:
        return sorted(self.counts())

    def select_by(self, *labels: object) -> DataFrame:
        """Samples of the given labels, in universe order; label partitions prune the read."""
        names = unique_labels(*labels)
        chosen = self.decisions().where(F.col("label").isin(names)).select("sample_index")
        return self.universe.rows.join(chosen, "sample_index", "left_semi").orderBy("sample_index")

    def selection(self, *labels: object) -> U.Selection:
        rows = self.universe.rows.join(self.decisions().select("sample_index", "label"), "sample_index", "left")
        return U.Selection(rows, (U.select_labels(F.col("label"), *unique_labels(*labels)),))


# -- bounded windows ----------------------------------------------------------------------------


@dataclass(frozen=True)
class DecisionView:
    """Decisions published window by window: ``produce`` makes the next missing one, ``load`` reads the longest prefix."""

    rule: FilterRule
    universe: U.Universe
    root: str

    @property
    def home(self) -> Path:
        return self.rule.home(self.root, self.universe) / "windows"

    def covered(self) -> int:
        stop = 0
        for start, end in sorted(tuple(map(int, p.parent.name.split("-"))) for p in self.home.glob("*-*/_SUCCESS")):
            if start > stop:
                break
            stop = max(stop, end)
        return stop

    def status(self) -> dict[str, object]:
        total, done = self.universe.sample_count, self.covered()
        return {"covered": done, "total": total, "sealed": done == total}

    def produce(self, max_samples: int) -> int:
        """Decide at most ``max_samples`` further samples; returns how many are covered then."""
        if max_samples < 1:
            raise ValueError("max_samples must be positive")
        with lock(self.home / "lock"):
            start = self.covered()
            stop = min(start + max_samples, self.universe.sample_count or 0)
            if start < stop:
                part = self.universe.rows.where((F.col("sample_index") >= start) & (F.col("sample_index") < stop))
                self.rule.decisions(part).write.mode("overwrite").parquet(str(self.home / f"{start:012d}-{stop:012d}"))
            return stop

    def load(self) -> tuple[DataFrame, int]:
        stop = self.covered()
        if not stop:
            raise LookupError("no window is published")
        paths = [str(p.parent) for p in self.home.glob("*-*/_SUCCESS") if int(p.parent.name.split("-")[1]) <= stop]
        return self.universe.rows.sparkSession.read.parquet(*paths), stop

    def select(self, *labels: object) -> DataFrame:
        """Selected samples of the published prefix; those behind it are not selected."""
        decided, stop = self.load()
        rows = self.universe.rows.join(decided.select("sample_index", "label"), "sample_index", "left")
        return rows.where(U.prefix_selected(F.col("sample_index"), F.col("label"), stop, *unique_labels(*labels))).drop("label")


def resume(rule: FilterRule, universe: U.Universe, done: DataFrame) -> DataFrame:
    """Decisions of what ``done`` (sample_index, label, metrics) lacks, and ``done``."""
    rest = universe.rows.join(done.select("sample_index"), "sample_index", "left_anti")
    return done.select("sample_index", "label", "metrics").unionByName(rule.decisions(rest))


def label_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("label").agg(F.count("*").alias("count"))
