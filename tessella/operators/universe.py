"""Complete sample spaces, decisions over them, and selections in three-valued logic.

A universe is a DataFrame with dense ``sample_index`` 0 .. N-1 and unique ``sample_id``.  A decision table is (sample_index, label), null
meaning unknown.  A selection is a nullable boolean: SQL's AND is exactly the wanted one (false wins over unknown).
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class UnknownDecisionError(LookupError):
    """A selection was asked for something that an undecided sample would settle."""

    def __init__(self, index: int):
        super().__init__(f"sample {index} is undecided")
        self.index = index


#: Keys of which the splits of :func:`number_rows` are taken; more only make the ranges more even.
_SPLIT_SAMPLE = 20_000


def _range_of(rows: DataFrame, order: list[str], parts: int) -> Column:
    """Number of the range, of about ``parts`` even ones, that a row's key falls in.

    The keys that part the ranges are literals, so the number depends on the row alone, however often and in whatever
    partitions the rows are computed.  They are taken of a sample: any keys give right ranges, these give even ones.
    """
    keys = rows.select(F.struct(*order).alias("k"))
    if (total := keys.count()) > _SPLIT_SAMPLE:
        keys = keys.sample(fraction=_SPLIT_SAMPLE / total, seed=5)
    ranked = keys.agg(F.sort_array(F.collect_set("k")).alias("k"))
    at = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.try_element_at("k", (1 + F.floor(i * F.size("k") / parts)).cast("int")))
    kind = ranked.schema["k"].dataType
    told = ranked.select(F.to_json(at)).first()[0]
    splits = F.array_distinct(F.sort_array(F.from_json(F.lit(told), kind)))  # what JSON can't hold makes another key, which does as well
    step = max(1, math.isqrt(parts))
    last = F.transform(F.sequence(F.lit(step), F.lit(step * step), F.lit(step)), lambda i: F.try_element_at(splits, i.cast("int")))
    told = ranked.sparkSession.range(1).select(F.to_json(splits), F.to_json(F.filter(last, lambda x: x.isNotNull()))).first()
    splits, last = (F.from_json(F.lit(x), kind) for x in told)
    until = lambda x, k: F.size(F.filter(x, lambda s: s <= k))
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  (computes c once)
    return bound(F.struct(*order), lambda k: bound(until(last, k), lambda w: w * step + until(F.slice(splits, w * step + 1, step), k)))


def number_rows(rows: DataFrame, order: list[str], name: str = "sample_index") -> DataFrame:
    """Dense numbers from 0 in ``order`` (nulls first), without one global window; rows that tie in it are numbered in any order.

    Each row belongs to a range of keys (:func:`_range_of`); a count for each range, which is all that reaches the driver, gives
    its offset, and the ranges are numbered on their own.  One shuffle of the rows, which must be the same each time they are computed.
    """
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("__p", _range_of(rows, order, parts))
    counts = {r["__p"]: r["count"] for r in ranged.groupBy("__p").count().collect()}
    if not counts:
        return rows.withColumn(name, F.lit(0).cast("long"))
    before = itertools.accumulate((counts.get(k, 0) for k in range(max(counts))), initial=0)
    offsets = F.from_json(F.lit(json.dumps([*before])), "array<bigint>")
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn(name, (F.get(offsets, F.col("__p")) + within).cast("long")).drop("__p")


def check_dense(rows: DataFrame, name: str = "sample_index") -> int:
    """Number of rows; raises unless ``name`` is 0 .. N-1, each once."""
    n, distinct, low, high, nulls = rows.agg(F.count("*"), F.countDistinct(name), F.min(name), F.max(name), F.count_if(F.col(name).isNull())).first()
    if nulls or distinct != n or (n and (low != 0 or high != n - 1)):
        raise ValueError(f"{name} is not dense: {n} rows, {distinct} distinct, from {low} to {high}, {nulls} nulls")
    return n


def check_unique(rows: DataFrame, name: str) -> None:
    twice = rows.groupBy(name).count().where(f"count > 1 or {name} is null").limit(1).collect()
    if twice:
        raise ValueError(f"{name} {twice[0][0]!r} is null or not unique")


@dataclass(frozen=True)
class Universe:
    """A stage's complete samples; operations see all of them, whatever is selected."""

    rows: DataFrame
    identity: str
    sample_count: int | None = None

    @classmethod
    def of(cls, rows: DataFrame, identity: str) -> Universe:
        check_unique(rows, "sample_id")
        return cls(rows, identity, check_dense(rows))


def select_labels(label: Column, *labels: str) -> Column:
    """True or false where decided, null where not."""
    return F.when(label.isNotNull(), label.isin(list(dict.fromkeys(labels))))


def prefix_selected(index: Column, label: Column, covered: int, *labels: str) -> Column:
    """Selection by a published prefix: exact within it, false (not unknown) behind it."""
    return (index < covered) & F.coalesce(label.isin(list(labels)), F.lit(False))


@dataclass(frozen=True)
class Selection:
    """An ordered intersection of nullable predicates over a universe with decision columns."""

    universe: DataFrame
    predicates: tuple[Column, ...] = field(default_factory=tuple)

    def also(self, predicate: Column) -> Selection:
        return Selection(self.universe, (*self.predicates, predicate))

    @property
    def selected(self) -> Column:
        return reduce(lambda a, b: a & b, self.predicates, F.lit(True))

    def unknown_indices(self) -> DataFrame:
        return self.universe.where(self.selected.isNull()).select("sample_index")

    def first_unknown(self) -> int | None:
        return self.unknown_indices().agg(F.min("sample_index")).first()[0]

    def rows(self) -> DataFrame:
        """Selected samples, numbered by ``position``; every decision must be known."""
        if (index := self.first_unknown()) is not None:
            raise UnknownDecisionError(index)
        return number_rows(self.universe.where(self.selected), ["sample_index"], "position")

    def selected_index(self, position: int) -> int:
        """The position-th selected sample (from 0); only decisions up to it must be known."""
        if position < 0:
            return self._from_end(position)
        top = self.universe.where(self.selected).select("sample_index").orderBy("sample_index").limit(position + 1).agg(F.max("sample_index"), F.count("*")).first()
        unknown = self.first_unknown()
        if top[1] <= position:
            if unknown is not None:
                raise UnknownDecisionError(unknown)
            raise IndexError(position)
        if unknown is not None and unknown < top[0]:
            raise UnknownDecisionError(unknown)
        return top[0]

    def _from_end(self, position: int) -> int:
        if (unknown := self.first_unknown()) is not None:
            raise UnknownDecisionError(unknown)
        top = self.universe.where(self.selected).select("sample_index").orderBy(F.desc("sample_index")).limit(-position).agg(F.min("sample_index"), F.count("*")).first()
        if top[1] < -position:
            raise IndexError(position)
        return top[0]


def rebase(decisions: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(sample_index, label) over ``target`` of decisions over ``source``; samples correspond one to one by sample_id."""
    left = source.select("sample_id", F.col("sample_index").alias("__from"))
    right = target.select("sample_id", F.col("sample_index").alias("__to"))
    check_unique(left, "sample_id")
    check_unique(right, "sample_id")
    both = left.join(right, "sample_id", "full_outer")
    lost = both.where("__from is null or __to is null").limit(1).collect()
    if lost:
        raise ValueError(f"sample_id {lost[0]['sample_id']!r} is in one universe only")
    return both.join(decisions.withColumnRenamed("sample_index", "__from"), "__from", "left").select(F.col("__to").alias("sample_index"), "label")


def rebase_selection(selection: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(sample_index, selected) over ``target`` of a selection over ``source``: true, false and unknown move with their samples."""
    moved = rebase(selection.select("sample_index", F.col("selected").alias("label")), source, target)
    return moved.select("sample_index", F.col("label").alias("selected"))


def project(decisions: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """As :func:`rebase`, but ``target`` may be a part of ``source``."""
    left = source.select("sample_id", F.col("sample_index").alias("__from"))
    check_unique(left, "sample_id")
    both = target.select("sample_id", F.col("sample_index").alias("__to")).join(left, "sample_id", "left")
    lost = both.where("__from is null").limit(1).collect()
    if lost:
        raise ValueError(f"sample_id {lost[0]['sample_id']!r} is not in the source")
    return both.join(decisions.withColumnRenamed("sample_index", "__from"), "__from", "left").select(F.col("__to").alias("sample_index"), "label")


def index_selection(rows: DataFrame, indices: DataFrame, count: int | None = None) -> DataFrame:
    """Rows at the given unique in-range indices, renumbered; ``indices`` has one column sample_index."""
    check_unique(indices, "sample_index")
    low, high = indices.agg(F.min("sample_index"), F.max("sample_index")).first()
    count = rows.count() if count is None else count
    if low is not None and (low < 0 or high >= count):
        raise IndexError(f"indices run from {low} to {high} of {count}")
    kept = rows.join(indices, "sample_index", "left_semi")
    return number_rows(kept.withColumnRenamed("sample_index", "global_index"), ["global_index"])


def merge_live(decided: DataFrame, chunk: DataFrame) -> DataFrame:
    """Decisions with one more published chunk; the same label again is fine, another one is an error."""
    both = decided.unionByName(chunk).groupBy("sample_index").agg(F.min("label").alias("label"), F.countDistinct("label").alias("__n"))
    return both.select("sample_index", F.when(F.col("__n") <= 1, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("conflicting decisions of sample "), F.col("sample_index").cast("string")))).alias("label"))


def finish_live(decided: DataFrame, total: int) -> DataFrame:
    """``decided``, or an error unless it has a label for each of the samples 0 .. total - 1: the end of a live selection."""
    n, low, high = decided.where("label is not null").agg(F.countDistinct("sample_index"), F.min("sample_index"), F.max("sample_index")).first()
    if n != total or (n and (low != 0 or high != total - 1)):
        raise ValueError(f"live decisions are incomplete: {n} of {total} samples, from {low} to {high}")
    return decided


def deep_equal(left: Column, right: Column) -> Column:
    """Whether two values are alike through all their structs and arrays: nulls equal nulls, NaN equals NaN, 0.0 equals -0.0."""
    return left.eqNullSafe(right)


def differing(left: DataFrame, right: DataFrame, key: str = "sample_index") -> DataFrame:
    """(key, columns): samples that differ, and in which columns; one that is on one side only differs in all of them."""
    names = sorted((set(left.columns) | set(right.columns)) - {key})
    side = lambda d, p: d.select(F.col(key), F.struct(*(F.col(c) if c in d.columns else F.lit(None).alias(c) for c in names)).alias(p))
    both = side(left, "__l").join(side(right, "__r"), key, "full_outer")
    alone = F.col("__l").isNull() | F.col("__r").isNull()
    parts = [F.when(alone | ~deep_equal(F.col(f"__l.{c}"), F.col(f"__r.{c}")), F.lit(c)) if c in left.columns and c in right.columns else F.lit(c) for c in names]
    return both.select(key, F.array_compact(F.array(*parts)).alias("columns")).where(F.size("columns") > 0)


def combine(left: DataFrame, right: DataFrame, key: str = "sample_index") -> DataFrame:
    """One row of two: items of both; an item on both sides merges its views (the same view twice is an error) and meta (equal values may repeat)."""
    refs = [c for c in left.columns if c != key and c in right.columns]
    a, b = left, right.select(key, *(F.col(c).alias(f"__{c}" if c in refs else c) for c in right.columns if c != key))
    out = a.join(b, key)
    for r in refs:
        parts = []
        for kind in ("views", "meta"):
            names = [{f.name for f in d.schema[r].dataType[kind].dataType.fields} if kind in d.schema[r].dataType.names else set() for d in (left, right)]
            if kind == "views" and names[0] & names[1]:
                raise ValueError(f"{r} has view {sorted(names[0] & names[1])} on both sides")
            fields = []
            for n in sorted(names[0] | names[1]):
                x, y = F.col(f"{r}.{kind}.{n}") if n in names[0] else None, F.col(f"__{r}.{kind}.{n}") if n in names[1] else None
                if x is not None and y is not None:
                    x = F.when(x.isNull() | y.isNull() | x.eqNullSafe(y), F.coalesce(x, y)).otherwise(F.raise_error(F.lit(f"{r}.meta.{n} differs")))
                fields.append((x if x is not None else y).alias(n))
            if fields:
                parts.append(F.struct(*fields).alias(kind))
        out = out.withColumn(r, F.struct(*parts)).drop(f"__{r}")
    return out


def identity(kind: str, **parts: object) -> str:
    """16 hex digits of a declared identity."""
    text = json.dumps({"kind": kind, **parts}, default=str, separators=(",", ":"), sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def sample_id(index: Column, name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lpad(index.cast("string"), 12, "0"), F.lit("-"), slug)
