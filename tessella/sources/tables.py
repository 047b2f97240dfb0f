"""Exported tables: Parquet or Arrow-exported splits, stores and snapshot catalogs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..plans import store
from ..spec import Spec
from . import register


def read_table(spark: SparkSession, spec: Spec) -> DataFrame:
    """A table of ``<path>/<config>/<split>`` (directories or .parquet files); a split is needed; streaming isn't offered."""
    options = dict(spec.options)
    if options.get("streaming"):
        raise ValueError("streaming reads are not offered; read the exported table")
    if options.get("config_name") and options.get("name"):
        raise ValueError("config_name and name exclude each other")
    if spec.split is None:
        raise ValueError("a table needs a split")
    base = Path(spec.path) / (options.get("config_name") or options.get("name") or "")
    for path in (base / spec.split, base / f"{spec.split}.parquet"):
        if path.exists():
            return store.with_index(spark.read.parquet(str(path)))
    raise FileNotFoundError(f"{base} has no split {spec.split}")


def read_disk(spark: SparkSession, spec: Spec) -> DataFrame:
    """A table saved to disk; a split exactly if it was saved as several."""
    base = Path(spec.path)
    splits = sorted(p.name for p in base.iterdir() if p.is_dir() and any(p.glob("*.parquet")))
    if bool(splits) != (spec.split is not None):
        raise ValueError(f"splits are {splits}, asked for {spec.split}")
    return store.with_index(spark.read.parquet(str(base / spec.split if spec.split else base)))


def read_store(spark: SparkSession, spec: Spec) -> DataFrame:
    options = dict(spec.options)
    return store.read(spark, spec.path, options.get("views"), allow_legacy=bool(options.get("allow_legacy")))


def read_snapshots(spark: SparkSession, spec: Spec) -> DataFrame:
    from ..streaming.snapshots import Catalog

    return Catalog(spec.path).read(spark)


register("table", read_table, ("config_name", "name", "streaming", "cache_dir", "num_proc", "token"))
register("disk", read_disk)
register("store", read_store, ("views", "allow_legacy", "file_mode"))
register("snapshots", read_snapshots)
