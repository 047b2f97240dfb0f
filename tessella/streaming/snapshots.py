"""Append-only snapshots: immutable segments in a catalog, published in bounded runs or by Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import universe as U
from ..plans.files import lock, write_json


class Catalog:
    """Segments [start, stop) of a growing universe; every published index is final."""

    def __init__(self, root: str):
        self.home = Path(root)

    def state(self) -> dict:
        path = self.home / "catalog.json"
        return json.loads(path.read_text()) if path.exists() else {"segments": [], "sealed": False, "batches": []}

    @property
    def stop(self) -> int:
        segments = self.state()["segments"]
        return segments[-1]["stop"] if segments else 0

    @property
    def sealed(self) -> bool:
        return self.state()["sealed"]

    def status(self, total: int | None = None) -> dict[str, object]:
        return {"published": self.stop, "total": total, "sealed": self.sealed}

    def read(self, spark: SparkSession, stop: int | None = None) -> DataFrame:
        """All samples below ``stop`` (default: all that are published now); later growth doesn't change it."""
        parts = self.state()["segments"]
        if not parts:
            raise LookupError(f"{self.home} has no segment")
        rows = spark.read.parquet(*(str(self.home / p["path"]) for p in parts if stop is None or p["start"] < stop))
        return rows if stop is None else rows.where(F.col("sample_index") < stop)

    def append(self, rows: DataFrame, batch: str | None = None, index: str | None = "sample_index") -> int:
        """Publish rows as the next segment; returns the new stop.  A batch that was published before changes nothing.

        With ``index``, rows carry their dense indexes, which must go on where the catalog stops; with None they are numbered."""
        with lock(self.home / "lock"):
            state = self.state()
            if state["sealed"]:
                raise ValueError("the catalog is sealed")
            if batch is not None and batch in state["batches"]:
                return self.stop
            start = self.stop
            path = f"segment-{start:012d}"
            if index is None:
                rows = U.number_rows(rows, rows.columns).withColumn("sample_index", F.col("sample_index") + start)
            rows.write.mode("overwrite").parquet(str(self.home / path))
            written = rows.sparkSession.read.parquet(str(self.home / path))
            n = U.check_dense(written.select((F.col("sample_index") - start).alias("sample_index")))
            if n:
                state["segments"].append({"path": path, "start": start, "stop": start + n})
            if batch is not None:
                state["batches"].append(batch)
            write_json(self.home / "catalog.json", state)
            return start + n

    def seal(self) -> None:
        with lock(self.home / "lock"):
            write_json(self.home / "catalog.json", self.state() | {"sealed": True})

    def produce(self, samples: DataFrame, derive: Callable[[DataFrame], DataFrame], max_new_samples: int, total: int | None = None) -> int:
        """Derive and publish at most so many further samples of a universe; seals when ``total`` is reached."""
        start = self.stop
        stop = self.append(derive(samples.where((F.col("sample_index") >= start) & (F.col("sample_index") < start + max_new_samples))))
        if total is not None and stop >= total:
            self.seal()
        return stop


def follow(stream: DataFrame, catalog: Catalog, derive: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Publish a stream's rows as segments until it has no more; micro-batches are idempotent by their number."""

    def publish(batch: DataFrame, number: int) -> None:
        catalog.append(derive(batch), batch=f"{checkpoint}:{number}", index=None)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decide_live(stream: DataFrame, decide: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Decisions of a stream of samples as they come: Parquet micro-batches of (sample_index, label)."""
    return decide(stream).select("sample_index", "label").writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
