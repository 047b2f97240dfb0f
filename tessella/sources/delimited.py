"""Tab- and comma-separated sources: all columns are strings, the empty string is no null, headers are unique and not empty."""

from __future__ import annotations

import hashlib
import re
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.universe import number_rows
from ..plans.files import canonical, lock, write_json
from ..spec import Spec
from . import register


def _header(path: str, sep: str) -> list[str]:
    import csv

    with open(path, newline="", encoding="utf-8-sig") as f:
        names = next(csv.reader(f, delimiter=sep), [])
    if not names or not all(names) or len(set(names)) < len(names):
        raise ValueError(f"{path}: the header must have unique, non-empty names")
    return names


def scan(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """Rows of files with one header, with their file and its line order (``_file``, ``_row``)."""
    names = _header(paths[0], sep)
    for p in paths[1:]:
        if _header(p, sep) != names:
            raise ValueError(f"{p} has another header than {paths[0]}")
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.schema(schema).csv(paths, sep=sep, header=True, multiLine=True, quote='"', escape='"', nullValue="\u0000", emptyValue="")
    # a multi-line file is one partition in order, so increasing ids follow its lines
    return rows.select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"), *(F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names))


def _local(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


def read_tsv(spark: SparkSession, spec: Spec) -> DataFrame:
    """A file, ``<root>/<split>.tsv``, or that split in each of the ordered ``subdirs``; ``root_field`` adds the directory."""
    options, root = dict(spec.options), Path(spec.path)
    subdirs = options.get("subdirs")
    if root.is_file():
        paths = [root]
    elif spec.split is None:
        raise ValueError("a directory of tsv files needs a split")
    else:
        paths = [root / d / f"{spec.split}.tsv" for d in subdirs] if subdirs else [root / f"{spec.split}.tsv"]
    for p in paths:
        if not p.is_file():
            raise FileNotFoundError(p)
    rows = scan(spark, [str(p) for p in paths], "\t")
    order = F.create_map(*(F.lit(x) for k, p in enumerate(paths) for x in (p.resolve().as_uri().replace("file:///", "file:/"), k)))
    clean = F.regexp_replace("_file", "^file:/+", "file:/")
    rows = rows.withColumn("_at", F.element_at(order, clean))
    if field := options.get("root_field"):
        rows = rows.withColumn(field, F.regexp_replace(F.regexp_replace("_file", "^file:/+", "/"), "/[^/]*$", ""))
    return number_rows(rows, ["_at", "_row"]).drop("_file", "_row", "_at")


def shard_files(root: str) -> list[tuple[int, int, str]]:
    """(shard, file, path) of ``shard_<i>/<n>.csv`` in numeric order; other names are ignored, equal numbers are an error."""
    found: dict[tuple[int, int], str] = {}
    for d in Path(root).iterdir():
        if not (m := re.fullmatch(r"shard_(\d+)", d.name)) or not d.is_dir():
            continue
        for f in d.iterdir():
            if not (n := re.fullmatch(r"(\d+)\.csv", f.name)):
                continue
            key = (int(m[1]), int(n[1]))
            if key in found:
                raise ValueError(f"{f} and {found[key]} have the same numbers")
            found[key] = str(f)
    if not found:
        raise FileNotFoundError(f"{root} has no shard_<i>/<n>.csv")
    return [(*k, p) for k, p in sorted(found.items())]


def missing_shards(shards: list[int]) -> list[tuple[int, int]]:
    """Gaps (first, last) between the shard numbers there are."""
    got = sorted(set(shards))
    return [(a + 1, b - 1) for a, b in zip(got, got[1:]) if b > a + 1]


def read_sharded_csv(spark: SparkSession, spec: Spec) -> DataFrame:
    files = shard_files(spec.path)
    rows = scan(spark, [p for _, _, p in files], ",")
    name = r"shard_(\d+)/(\d+)\.csv$"
    rows = rows.withColumn("_shard", F.regexp_extract("_file", name, 1).cast("long")).withColumn("_n", F.regexp_extract("_file", name, 2).cast("long"))
    return number_rows(rows, ["_shard", "_n", "_row"]).drop("_file", "_shard", "_n", "_row")


def prepare(spark: SparkSession, files: list[str], target: str, sep: str = ",") -> list[str]:
    """Parquet parts of delimited files, one directory each; unchanged files (size and times) keep theirs.  Returns what was read anew."""
    home = Path(target)
    with lock(home / "lock"):
        manifest = home / "manifest.json"
        import json

        old = json.loads(manifest.read_text()) if manifest.exists() else {}
        new, done = {}, []
        for k, path in enumerate(files):
            stamp = _stamp(path)
            part = f"part-{k:05d}-{hashlib.sha256(canonical([path, stamp]).encode()).hexdigest()[:16]}"
            if path in old and old[path]["stamp"] == stamp and (home / old[path]["part"] / "_SUCCESS").exists():
                new[path] = old[path]
                continue
            scan(spark, [path], sep).drop("_file").orderBy("_row").write.mode("overwrite").parquet(str(home / part))
            if _stamp(path) != stamp:
                raise RuntimeError(f"{path} changed while it was read")
            new[path] = {"stamp": stamp, "part": part}
            done.append(path)
        write_json(manifest, new)
        for part in {x["part"] for x in old.values()} - {x["part"] for x in new.values()}:
            shutil.rmtree(home / part, ignore_errors=True)
        return done


def _stamp(path: str) -> list[int]:
    s = Path(path).stat()
    return [s.st_size, s.st_mtime_ns, s.st_ctime_ns]


def prepared(spark: SparkSession, target: str) -> DataFrame:
    """Rows of all prepared parts in file order, numbered."""
    import json

    parts = json.loads((Path(target) / "manifest.json").read_text())
    paths = [str(Path(target) / p["part"]) for p in parts.values()]
    rows = None
    for k, p in enumerate(paths):
        part = spark.read.parquet(p).withColumn("_at", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise LookupError(f"nothing is prepared in {target}")
    return number_rows(rows, ["_at", "_row"]).drop("_at", "_row")


register("tsv", read_tsv, ("subdirs", "root_field"))
register("sharded_csv", read_sharded_csv)
