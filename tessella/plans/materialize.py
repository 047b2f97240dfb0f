"""Materialization: providers derive new views, modalities or whole samples, a batch at a time, in Arrow UDFs.

A provider is made once a task by its ``factory`` and takes a pandas DataFrame of its inputs, one row a sample.  Batches that exhaust
memory are halved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.pandas.types import to_arrow_type

from .. import schema as S
from ..functions import batches as B
from .store import refs

Provider = Callable[[pd.DataFrame], Sequence]


def call_split(provider: Provider, batch: pd.DataFrame, exhausted: type[BaseException] = MemoryError) -> list:
    """One output a row; where memory runs out, both halves are tried."""
    try:
        out = list(provider(batch))
    except exhausted:
        if len(batch) < 2:
            raise
        half = len(batch) // 2
        return call_split(provider, batch.iloc[:half], exhausted) + call_split(provider, batch.iloc[half:], exhausted)
    if len(out) != len(batch):
        raise ValueError(f"a provider returned {len(out)} outputs for {len(batch)} samples")
    return out


def provide(factory: Callable[[], Provider], kind: str, batch_size: int = B.ROWS) -> Callable[..., Column]:
    """Column function of a provider; rows whose first input is null get null (or a struct of nulls).

    A provider gets at most ``batch_size`` rows, and fewer where they are large; what it made of them leaves the worker before the next.
    """
    made = to_arrow_type(t.DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        provider = factory()
        for batch in B.pieces(batches, batch_size):
            out, some = [None] * len(batch), batch.index[batch.iloc[:, 0].notna()]
            for i, v in zip(some, call_split(provider, batch.loc[some]) if len(some) else []):
                out[i] = v
            yield _array(out, made)

    return lambda *inputs: run(F.struct(*(F.col(c).alias(f"c{i}") if isinstance(c, str) else c.alias(f"c{i}") for i, c in enumerate(inputs))))


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """Outputs in Arrow; those of a struct name its fields."""
    if not pa.types.is_struct(kind):
        return pa.Array.from_pandas(pd.Series(values, dtype=object), type=kind)
    parts = [pa.Array.from_pandas(pd.Series([None if v is None else v[f.name] for v in values], dtype=object), type=f.type) for f in kind]
    return pa.StructArray.from_arrays(parts, fields=list(kind))


@dataclass(frozen=True)
class ViewMaterializer:
    """Adds a view to every item of a modality.  The result has that view only, and the items and fields of ``keep``."""

    view: str
    factory: Callable[[], Provider]
    inputs: tuple[str, ...]
    modality: str = "audio"
    kind: str | None = None
    keep: S.Schema | None = None

    def __call__(self, samples: DataFrame) -> DataFrame:
        kind = self.kind or S.VIEWS[S.Modality(self.modality)][self.view].simpleString()
        udf = provide(self.factory, kind)
        out = S.select(samples, self.keep) if self.keep else samples.select(*(c for c in ("sample_index", "sample_id") if c in samples.columns))
        own = [r for r in refs(samples) if r.endswith(f"_{self.modality}")]
        if not own:
            raise KeyError(f"no {self.modality} items")
        made = samples.select("sample_index", *(F.when(F.col(r).isNotNull(), F.struct(F.struct(udf(*(f"{r}.views.{v}" for v in self.inputs)).alias(self.view)).alias("views"))).alias(r) for r in own))
        if not self.keep:
            return samples.select(*out.columns, *(F.when(F.col(r).isNotNull(), F.struct(F.struct(udf(*(f"{r}.views.{v}" for v in self.inputs)).alias(self.view)).alias("views"))).alias(r) for r in own))
        from ..operators.universe import combine

        return combine(out, made)


@dataclass(frozen=True)
class ModalityMaterializer:
    """Creates a missing modality for each role from its only other one; an existing one is an error."""

    modality: str
    view: str
    factory: Callable[[], Provider]
    source: str
    roles: tuple[str, ...] = ("default",)
    reference_role: str | None = None
    kind: str | None = None

    def __call__(self, samples: DataFrame) -> DataFrame:
        kind = self.kind or S.VIEWS[S.Modality(self.modality)][self.view].simpleString()
        udf, out = provide(self.factory, kind), samples
        for role in self.roles:
            made = S.ref(role, self.modality)
            if made in samples.columns:
                raise ValueError(f"{made} exists already")
            others = [r for r in refs(samples) if r.startswith(f"{role}_")]
            if len(others) != 1:
                raise ValueError(f"{role} needs exactly one other modality, has {others}")
            inputs = [f"{others[0]}.views.{self.source}"]
            if self.reference_role and self.reference_role != role:
                inputs.append(f"{S.ref(self.reference_role, self.modality)}.views.{self.view}")
            out = out.withColumn(made, F.when(F.col(others[0]).isNotNull(), F.struct(F.struct(udf(*inputs).alias(self.view)).alias("views"))))
        return out


@dataclass(frozen=True)
class SampleMaterializer:
    """A provider over whole samples: takes and returns Arrow-convertible pandas frames of the given schema."""

    factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
    schema: str

    def __call__(self, samples: DataFrame) -> DataFrame:
        factory = self.factory

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            provider = factory()
            for batch in batches:
                out = provider(batch)
                if len(out) != len(batch):
                    raise ValueError(f"a provider returned {len(out)} samples for {len(batch)}")
                yield out

        return samples.mapInPandas(run, self.schema)


def completed_prefix(done: DataFrame, index: str = "sample_index") -> int:
    """How many samples from 0 on are there without a gap: by partition counts of a sorted range, not by one window."""
    block = 1 << 16
    by = done.select(index).distinct().groupBy(F.floor(F.col(index) / block).alias("b")).agg(F.count("*").alias("n"), F.max(index).alias("m"))
    full = by.where(F.col("n") == block).select("b")
    spark = done.sparkSession
    top = by.agg(F.max("b")).first()[0]
    if top is None:
        return 0
    first = spark.range(top + 2).join(full, F.col("id") == F.col("b"), "left_anti").agg(F.min("id")).first()[0]
    lo = first * block
    rest = spark.range(lo, lo + block).join(done.where((F.col(index) >= lo) & (F.col(index) < lo + block)).select(index), F.col("id") == F.col(index), "left_anti").agg(F.min("id")).first()[0]
    return rest if rest is not None else lo + block


def write_bounded(samples: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, max_new_samples: int | None = None, sample_indexes: Sequence[int] | None = None, finalize: bool = True) -> int:
    """Make and append to ``path`` what is still to do, as a whole or within the limits; returns how many samples are left.

    Limits need ``finalize=False``.  A run that finalizes raises if something is left.  What is there already stays, so a run that ended early goes on where it ended.
    """
    if finalize and (max_new_samples is not None or sample_indexes is not None):
        raise ValueError("a limited run can't finalize")
    spark = samples.sparkSession
    try:
        done = spark.read.parquet(path).select("sample_index")
    except AnalysisException:
        done = None
    todo = samples if sample_indexes is None else samples.where(F.col("sample_index").isin(sorted(set(sample_indexes))))
    make(bounded(todo, done, max_new_samples)).write.mode("append").parquet(path)
    left = samples.join(spark.read.parquet(path).select("sample_index"), "sample_index", "left_anti").count()
    if finalize and left:
        raise ValueError(f"{left} samples have no result")
    return left


def bounded(samples: DataFrame, done: DataFrame | None, max_new_samples: int | None) -> DataFrame:
    """Samples that are still to do, the first ``max_new_samples`` of them."""
    rest = samples if done is None else samples.join(done.select("sample_index"), "sample_index", "left_anti")
    return rest if max_new_samples is None else rest.orderBy("sample_index").limit(max_new_samples)
