"""Sources by name: each is a function (spark, spec) -> DataFrame with a dense sample_index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..spec import Spec

Reader = Callable[[SparkSession, Spec], DataFrame]
_readers: dict[str, tuple[Reader, frozenset[str]]] = {}


def register(name: str, reader: Reader, options: tuple[str, ...] = ()) -> None:
    _readers[name] = (reader, frozenset(options))


def exists(name: str) -> bool:
    return name in _readers


def read(spark: SparkSession, spec: Spec) -> DataFrame:
    if spec.source not in _readers:
        raise KeyError(f"no source {spec.source!r}; there are {sorted(_readers)}")
    reader, allowed = _readers[spec.source]
    if unknown := {k for k, _ in spec.options} - allowed:
        raise TypeError(f"{spec.source} has no options {sorted(unknown)}")
    return reader(spark, spec)


from . import delimited, files, tables  # noqa: E402, F401
