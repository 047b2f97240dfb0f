"""Vectorised text kernels shared by the corpus operators.

Everything here runs inside an executor's Python worker on Arrow batches and touches whole texts;
nothing in this module knows about Spark except :func:`shared_checkpoints`.

A *word* is a maximal run of letters, marks and digits, compared without case (simple one-to-one
lower-casing).  A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters handled at once; bounds a worker's memory at about 100 bytes a character.
SLICE_CHARS = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FINISH = np.uint64(0xFF51AFD7ED558CCD)


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point -> lower-cased code point for word characters, 0 for everything else."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    category, skip = unicodedata.category, ("C", "P", "S", "Z")
    for lo, hi in ((0, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x18D00), (0x1AFF0, 0x20000), (0xE0100, 0xE01F0)):
        for code in range(lo, hi):
            if not category(chr(code)).startswith(skip):
                low = chr(code).lower()
                table[code] = ord(low) if len(low) == 1 else code
    for lo, hi in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x18D00, 0x18D09), (0x20000, 0x323B0)):  # ideographs and syllables have no case
        table[lo:hi] = np.arange(lo, hi)
    return table


@lru_cache(maxsize=1)
def token_table() -> np.ndarray:
    """Code point -> itself plus one, 0 for white space: the table that splits at white space and keeps case and marks."""
    table = np.arange(1, sys.maxunicode + 2, dtype=np.uint32)
    table[[c for c in range(0x3001) if chr(c).isspace()]] = 0
    return table


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_CHARS + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            seq = np.full(size, base, np.uint64)
            seq[0] = 1
            _powers[name] = np.multiply.accumulate(seq)
    return _powers["up"], _powers["down"]


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _give_back() -> None:
    """Return freed memory to the system: workers live on between stages, and an executor has two or more of them."""
    pa.default_memory_pool().release_unused()
    if (trim := _allocator()) is not None:
        trim(0)


@lru_cache(maxsize=1)
def _allocator():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a batch into runs of rows of at most ``limit`` characters (a longer text stands alone); texts become Python strings run by run."""
    column = batch.column(text)
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        part = batch.slice(lo, hi - lo)
        yield part, texts_of(part.column(text))
        lo = hi
    _give_back()


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the n + 1 offsets of the texts in them."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), offsets


def finish(h: np.ndarray) -> np.ndarray:
    """Final mix: spreads every bit of the sum to the high bits."""
    h = h ^ (h >> np.uint64(32))
    h *= _FINISH
    h ^= h >> np.uint64(29)
    return h


class Words:
    """Words of several texts (of ``fold_table`` unless another is given): 64-bit ``raw`` hashes, character ``start``/``end``, and ``bounds`` of each text's words."""

    def __init__(self, texts: list[str], table: np.ndarray | None = None):
        codes, offsets = codes_of(texts)
        n = len(codes)
        folded = (fold_table() if table is None else table)[codes]
        inside = folded != 0
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        edge = np.empty(n + 1, bool)  # a word may begin here
        edge[0] = True
        np.logical_not(inside[:-1] if n else inside, out=edge[1:n] if n else edge[1:])
        edge |= first
        self.start = np.flatnonzero(inside & edge[:n])
        stop = np.empty(n + 1, bool)  # a word may end before here
        stop[:n] = ~inside
        stop[n] = True
        stop |= first
        self.end = np.flatnonzero(inside & stop[1:]) + 1
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((folded.astype(np.uint64) * _STEP) * up[:n], out=sums[1:])
        self.raw = (sums[self.end] - sums[self.start]) * down[self.start]
        self.bounds = np.searchsorted(self.start, offsets)
        self.offsets = offsets

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def ngrams(words: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of consecutive words in each text, and their bounds by text.

    ``short``: a text of 1 to n - 1 words has one gram, of all its words.
    """
    raw, bounds, counts = words.raw, words.bounds, words.counts()
    total = max(0, len(raw) - n + 1)
    h = np.zeros(total, np.uint64)
    for k in range(n):
        h *= _STEP
        h += raw[k : k + total]
    each = np.maximum(counts - n + 1, 0)
    valid = np.ones(total, bool)
    for k in range(1, n):  # grams that would run over the end of a text
        at = bounds[1:][counts >= k] - k
        valid[at[at < total]] = False
    h = finish(h[valid] + np.uint64(n))
    out = np.concatenate([[0], np.cumsum(each)])
    if short and (few := np.flatnonzero((counts > 0) & (counts < n))).size:
        extra = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            on = counts[few] > k
            extra[on] = extra[on] * _STEP + raw[bounds[few][on] + k]
        h = np.insert(h, out[few], finish(extra + counts[few].astype(np.uint64)))
        each = each.copy()
        each[few] = 1
        out = np.concatenate([[0], np.cumsum(each)])
    return h, out


def shared_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable: the cluster's shared folder; in local mode, where there is one machine, one of our own if none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessella-"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder in whatever file system it is."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
