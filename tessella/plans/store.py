"""The durable store: samples as one Parquet table of nested columns, with a manifest and a commit marker."""

from __future__ import annotations

import json
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import universe as U
from .files import lock, write_json

VERSION = 3


def with_index(rows: DataFrame, name: str = "sample_index") -> DataFrame:
    """Add a dense index in file order, unless there is one."""
    if name in rows.columns:
        return rows
    placed = rows.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"))
    return U.number_rows(placed, ["__f", "__r"], name).drop("__f", "__r")


def write_part(samples: DataFrame, root: str, part: str, max_shard_samples: int = 100_000) -> None:
    """One part of a store, by any number of tasks; it counts only once it is committed."""
    samples.repartitionByRange("sample_index").sortWithinPartitions("sample_index").write.mode("overwrite").option("maxRecordsPerFile", max_shard_samples).parquet(str(Path(root, "parts", part)))


def commit(spark: SparkSession, root: str, dataset_id: str, split: str | None = None, start: int = 0, expected: int | None = None, repack: int | None = None, provenance: dict | None = None) -> int:
    """Merge all parts: indexes are disjoint and dense from ``start``, ids unique; then the manifest and ``.ready``."""
    home = Path(root)
    with lock(home / "lock"):
        parts = sorted(p for p in (home / "parts").iterdir() if (p / "_SUCCESS").exists())
        if not parts:
            raise LookupError(f"{root} has no finished part")
        rows = None
        for p in parts:
            one = spark.read.parquet(str(p))
            rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        n = U.check_dense(rows.select((F.col("sample_index") - start).alias("sample_index")))
        U.check_unique(rows, "sample_id")
        if expected is not None and n != expected:
            raise ValueError(f"{n} samples, not {expected}")
        name = f"samples-{uuid.uuid4().hex}"
        out = rows.repartitionByRange(repack, "sample_index") if repack else rows.repartitionByRange("sample_index")
        out.sortWithinPartitions("sample_index").write.parquet(str(home / name))
        views = {c: [f.name for f in rows.schema[c].dataType["views"].dataType.fields] for c in refs(rows)}
        write_json(home / "dataset.json", {"version": VERSION, "dataset_id": dataset_id, "split": split, "samples": name, "count": n, "start": start, "views": views, "provenance": provenance or {}})
        (home / ".ready").touch()
        shutil.rmtree(home / "parts")
        return n


def write(samples: DataFrame, root: str, dataset_id: str, split: str | None = None, views: dict[str, list[str]] | None = None, max_shard_samples: int = 100_000, **options) -> int:
    """Write and commit a whole store; ``views`` restricts what is kept."""
    if (Path(root) / ".ready").exists():
        raise FileExistsError(root)
    write_part(samples if views is None else keep_views(samples, views), root, "all", max_shard_samples)
    return commit(samples.sparkSession, root, dataset_id, split, **options)


def refs(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema.fields if f.dataType.typeName() == "struct" and "views" in f.dataType.names]


def keep_views(rows: DataFrame, views: dict[str, list[str]]) -> DataFrame:
    """Only the given views of the given items (nested pruning reaches the scan); unknown ones raise KeyError, repeated ones ValueError."""
    columns = [c for c in rows.columns if c not in refs(rows)]
    out = [F.col(c) for c in columns]
    for r, names in views.items():
        if len(set(names)) < len(names):
            raise ValueError(f"a view of {r} is named twice")
        if r not in rows.columns:
            raise KeyError(r)
        have = rows.schema[r].dataType["views"].dataType.names
        if unknown := [n for n in names if n not in have]:
            raise KeyError(f"{r} has no views {unknown}")
        parts = [F.struct(*(F.col(f"{r}.views.{n}") for n in names)).alias("views")]
        if "meta" in rows.schema[r].dataType.names:
            parts.append(F.col(f"{r}.meta").alias("meta"))
        out.append(F.when(F.col(r).isNotNull(), F.struct(*parts)).alias(r))
    return rows.select(*out)


def manifest(root: str, allow_legacy: bool = False) -> dict:
    if not (Path(root) / ".ready").exists():
        raise FileNotFoundError(f"{root} is no committed store")
    m = json.loads((Path(root) / "dataset.json").read_text())
    if m["version"] != VERSION and not (allow_legacy and m["version"] == 2):
        raise ValueError(f"{root} has version {m['version']}; migrate it first")
    return m


def read(spark: SparkSession, root: str, views: dict[str, list[str]] | None = None, allow_legacy: bool = False) -> DataFrame:
    rows = spark.read.parquet(str(Path(root) / manifest(root, allow_legacy)["samples"]))
    return rows if views is None else keep_views(rows, views)


def migrate(spark: SparkSession, root: str) -> None:
    """From version 1 (no provenance, flat text columns) to the current one."""
    home = Path(root)
    m = json.loads((home / "dataset.json").read_text())
    if m["version"] == VERSION:
        return
    rows = spark.read.parquet(str(home / m["samples"]))
    for c in [c for c in rows.columns if c.endswith("_text") and rows.schema[c].dataType.typeName() == "string"]:
        rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.struct(F.struct(F.col(c).alias("text")).alias("views"))))
    name = f"samples-{uuid.uuid4().hex}"
    rows.write.parquet(str(home / name))
    views = {c: rows.schema[c].dataType["views"].dataType.names for c in refs(rows)}
    write_json(home / "dataset.json", {"provenance": {}, **m, "version": VERSION, "samples": name, "views": views})


def coverage(samples: DataFrame, view_rows: DataFrame) -> DataFrame:
    """(sample_index, problem): samples without a view row, view rows without a sample, and repeated ones."""
    rows = view_rows.groupBy("sample_index").agg(F.count("*").alias("__n"))
    both = samples.select("sample_index", F.lit(1).alias("__s")).join(rows, "sample_index", "full_outer")
    problem = F.when(F.col("__n").isNull(), "missing view").when(F.col("__s").isNull(), "unknown sample").when(F.col("__n") > 1, "repeated view")
    return both.select("sample_index", problem.alias("problem")).where("problem is not null")


def check_integrity(spark: SparkSession, root: str, level: str = "normal") -> int:
    """``fast``: the manifest and its files; ``normal``: also the count and the index; ``full``: also ids and every declared view of a present item."""
    m = manifest(root)
    rows = read(spark, root)
    if level == "fast":
        return m["count"]
    n = U.check_dense(rows.select((F.col("sample_index") - m["start"]).alias("sample_index")))
    if n != m["count"]:
        raise ValueError(f"{n} samples, the manifest says {m['count']}")
    if level == "full":
        U.check_unique(rows, "sample_id")
        for r, names in m["views"].items():
            for v in names:
                lost = rows.where(f"{r} is not null and {r}.views.`{v}` is null").limit(1).collect()
                if lost:
                    raise ValueError(f"sample {lost[0]['sample_index']} lacks view {r}.{v}")
    return n
