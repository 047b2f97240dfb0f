"""Trees of files, by listing: one row for each file, optionally with its bytes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.universe import number_rows
from ..spec import Spec
from . import register


def check_listing(paths: list[str], prefix: str, suffixes: tuple[str, ...]) -> list[str]:
    """Sorted paths under the prefix with one of the suffixes; unique, and at least one."""
    kept = sorted(p for p in paths if p.startswith(prefix) and (not suffixes or p.endswith(suffixes)))
    if not kept:
        raise FileNotFoundError(f"no files under {prefix!r} ending in {suffixes}")
    if len(set(kept)) < len(kept):
        raise ValueError("a path is listed twice")
    return kept


def listing(pages) -> list[str]:
    """All paths of a paged listing (page: (paths, next address or None)); a repeated address is an error."""
    seen, out = set(), []
    for address, (paths, following) in pages:
        if address in seen:
            raise RuntimeError(f"the listing returns to {address}")
        seen.add(address)
        out += paths
        if following is None:
            return out
    raise RuntimeError("the listing breaks off")


def read_files(spark: SparkSession, spec: Spec) -> DataFrame:
    """(sample_index, repo_id, revision, path, local_path) of the files under ``<root>/<prefix>``; ``bytes=True`` adds content."""
    options, root = dict(spec.options), Path(spec.path)
    suffixes = tuple(options.get("suffixes", ()))
    paths = check_listing([str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()], options.get("prefix", ""), suffixes)
    if not options.get("bytes"):
        rows = spark.createDataFrame([(i, root.name, spec.version or "main", p, str(root / p)) for i, p in enumerate(paths)], "sample_index long, repo_id string, revision string, path string, local_path string")
        return rows
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root))
    base = str(root.resolve())
    local = F.regexp_replace("path", "^file:/*", "/")
    rows = every.select(local.alias("local_path"), F.substring(local, F.lit(len(base) + 2), F.length(local)).alias("path"), "content", "length")
    rows = rows.where(F.col("path").startswith(options.get("prefix", "")))
    if suffixes:
        rows = rows.where("false" if not suffixes else " or ".join(f"endswith(path, '{s}')" for s in suffixes))
    return number_rows(rows, ["path"]).select("sample_index", F.lit(root.name).alias("repo_id"), F.lit(spec.version or "main").alias("revision"), "path", "local_path", "content")


register("files", read_files, ("prefix", "suffixes", "bytes"))
