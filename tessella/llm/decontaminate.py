"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of one task, of about ``shard_words`` words.  Its text is the sequence of word ids (words without
case, marks and white space don't count) with a separator after each document.  From its suffix array come the
Burrows-Wheeler transform, stored as a wavelet matrix with rank counts, and the suffix positions sampled at every
``sample``-th place of the text.  All test phrases, the windows of ``phrase`` words of every benchmark item (an item of
fewer words is one phrase), are searched backward at once; rows of their intervals walk to a
sampled position to be located.  Overlapping or adjoining occurrences merge into removal spans of characters, from the first
to the last matched word.

Defined results: null and empty texts and items match nothing; a null doc_id is an ordinary row; repeated rows are each
reported; items that are equal, or share a phrase, are all listed, in order; no item is too short to be searched, so an item of one word takes that word out of every text; very long
texts are shards of their own, taken whole; an empty table on either side gives no spans; other columns, whatever their names, are ignored by :func:`spans` and passed on
unchanged by :func:`clean`.

Plan: one narrow scan of the documents, no shuffle.  The distinct phrases are a table that Spark makes; the driver passes it on in pieces of at most ``chunk``
phrases, holding one piece at a time, each a broadcast variable of that bounded size.  A task searches one piece after another over the same index, so
that what a round holds stays bounded as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel


@dataclass(frozen=True)
class Search:
    phrase: int = 8
    shard_words: int = 1 << 19
    sample: int = 16
    chunk: int = 1 << 18


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Start positions of the sorted suffixes; the last symbol must be 0 and occur nowhere else."""
    n = len(text)
    bits = max(1, int(sigma - 1).bit_length())
    width = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: n - k] |= text[k:] if k < n else 0
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, np.int64)
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # a group's rank is the place of its first suffix
    rank[order] = head
    step = width
    while True:
        single = fresh & np.concatenate([fresh[1:], [True]])
        at = np.flatnonzero(~single)
        if not len(at):
            return order
        # only suffixes that still share a rank are sorted again, by the rank of what follows
        rows, group = order[at], head[at]
        follow = rows + step
        next_rank = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        by = np.argsort((group << 32) | (next_rank + 1), kind="stable")
        rows, next_rank = rows[by], next_rank[by]
        order[at] = rows
        changed = np.concatenate([[True], (group[1:] != group[:-1]) | (next_rank[1:] != next_rank[:-1])])
        fresh[at] = changed
        head[at] = np.maximum.accumulate(np.where(changed, at, 0))
        rank[rows] = head[at]
        step *= 2


class Wavelet:
    """Wavelet matrix: ``rank(symbols, places)`` counts a symbol before a place, for many at once."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        seq = seq.astype(np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> np.uint32(level)) & np.uint32(1) != 0
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(len(seq) - int(np.count_nonzero(bit)))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place on the last level, where equal symbols are together; the difference of two such places is a count."""
        for level in range(self.bits):
            one = (symbols >> (self.bits - 1 - level)) & 1 != 0
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and the places on the last level."""
        symbols = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            one = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
            ones = self._ones(level, at)
            symbols = (symbols << 1) | one
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return symbols, at


class FMIndex:
    """Index of one text of symbols 1 .. sigma - 1 (0 is appended as its end)."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int):
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text, sigma)
        self.size, self.sample = len(text), sample
        self.wavelet = Wavelet(text[order - 1], sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        symbols = np.arange(sigma)
        self.base = self.wavelet.descend(symbols, np.zeros(sigma, np.int64))
        self.marked = order % sample == 0
        self.place = np.cumsum(self.marked) - 1
        self.positions = order[self.marked]

    def _step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.less[symbols] + self.wavelet.descend(symbols, rows) - self.base[symbols]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of phrases (right-aligned in a matrix; a symbol of 0 occurs nowhere)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        width = phrases.shape[1]
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(live):
                break
            symbols = phrases[live, width - 1 - k]
            none = symbols == 0
            hi[live[none]] = lo[live[none]]
            live, symbols = live[~none], symbols[~none]
            lo[live], hi[live] = self._step(symbols, lo[live]), self._step(symbols, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows."""
        out, walked, at = np.zeros(len(rows), np.int64), 0, rows
        todo = np.arange(len(rows))
        while len(todo):
            done = self.marked[at]
            out[todo[done]] = self.positions[self.place[at[done]]] + walked
            todo, at = todo[~done], at[~done]
            symbols, last = self.wavelet.access(at)
            at = self.less[symbols] + last - self.base[symbols]
            walked += 1
        return out


@dataclass
class Phrases:
    """Distinct phrases: hashes of their words, right-aligned, and the items that have them."""

    words: np.ndarray
    lengths: np.ndarray
    items: list[list[int]]

    @classmethod
    def of(cls, table: pa.Table, s: Search) -> Phrases:
        """Of rows (phrase, items), a phrase being the bytes of its words' hashes."""
        found = [np.frombuffer(x, np.uint64) for x in table.column("phrase").to_pylist()]
        words = np.zeros((len(found), s.phrase), np.uint64)
        for i, h in enumerate(found):
            words[i, s.phrase - len(h) :] = h
        return cls(words, np.array([len(h) for h in found], np.int64), table.column("items").to_pylist())


def phrase_table(benchmark: DataFrame, s: Search) -> DataFrame:
    """(phrase, items): every distinct phrase of the benchmark and the sorted items that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in kernel.slices(batch):
                words, at, found = kernel.Words(texts), [], []
                for i, (lo, hi) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
                    n = min(hi - lo, s.phrase)
                    if n:
                        own = {words.raw[k : k + n].tobytes() for k in range(lo, hi - n + 1)}
                        found += own
                        at += [i] * len(own)
                yield pa.record_batch({"phrase": pa.array(found, pa.binary()), "item": part.column("item_id").take(pa.array(at, pa.int64()))})

    each = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(run, "phrase binary, item long")
    return each.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


def occurrences(words: kernel.Words, pieces: Iterable[Phrases], s: Search) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray]]:
    """Of each piece that occurs: (it, number of a word, number of the phrase that begins there), by one FM-index over all the texts."""
    index = None
    for phrases in pieces:
        if not len(phrases.words) or not len(words.raw):
            continue
        if index is None:
            values, ids = np.unique(words.raw, return_inverse=True)
            counts = words.counts()
            texts = np.repeat(np.arange(len(counts)), counts)
            text = np.ones(len(ids) + len(counts), np.int64)  # 1 separates documents
            text[np.arange(len(ids)) + texts] = ids + 2
            index = FMIndex(text, len(values) + 2, s.sample)
        at = np.minimum(np.searchsorted(values, phrases.words), len(values) - 1)
        symbols = np.where(values[at] == phrases.words, at + 2, 0)
        lo, hi = index.search(symbols, phrases.lengths)
        many = np.maximum(hi - lo, 0)
        if not many.any():
            continue
        place = index.locate(np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        owner = np.searchsorted(np.cumsum(counts + 1), place, side="right")
        yield phrases, place - owner, np.repeat(np.arange(len(many)), many)


def _merged(words: kernel.Words, first: np.ndarray, lengths: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of the merged spans, in characters of the text."""
    out: list[tuple[int, int, int]] = []
    last = -1
    for k in np.lexsort((first, text)):
        a, b, t = int(first[k]), int(first[k] + lengths[k]), int(text[k])
        if out and out[-1][0] == t and a <= last:
            if b > last:
                out[-1], last = (t, out[-1][1], int(words.end[b - 1] - words.offsets[t])), b
        else:
            out.append((t, int(words.start[a] - words.offsets[t]), int(words.end[b - 1] - words.offsets[t])))
            last = b
    return out


def _matches(texts: list[str], pieces: Iterable[Phrases], s: Search) -> dict[int, tuple[list[tuple[int, int]], list[int]]]:
    """By number of the text: removal spans and items."""
    words = kernel.Words(texts)
    none = np.zeros(0, np.int64)
    first, lengths, items = [none], [none], {}
    for phrases, at, which in occurrences(words, pieces, s):
        first.append(at)
        lengths.append(phrases.lengths[which])
        owner = np.searchsorted(words.bounds, at, side="right") - 1
        for t, p in set(zip(owner.tolist(), which.tolist())):
            items.setdefault(t, set()).update(phrases.items[p])
    at = np.concatenate(first)
    out: dict[int, tuple[list[tuple[int, int]], list[int]]] = {}
    for t, a, b in _merged(words, at, np.concatenate(lengths), np.searchsorted(words.bounds, at, side="right") - 1):
        out.setdefault(t, ([], sorted(items[t])))[0].append((a, b))
    return out


def _shards(batches: Iterator[pa.RecordBatch], s: Search) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        yield from kernel.slices(batch, limit=6 * s.shard_words)


class _Pieces:
    """Pieces of the phrase table, each a broadcast variable; iterating holds one of them at a time."""

    def __init__(self, spark: SparkSession, table: DataFrame, s: Search):
        self.held, piece = [], []
        for row in table.toLocalIterator():
            piece.append((bytes(row["phrase"]), row["items"]))
            if len(piece) == s.chunk:
                self.held.append(self._send(spark, piece, s))
                piece = []
        if piece:
            self.held.append(self._send(spark, piece, s))

    @staticmethod
    def _send(spark: SparkSession, piece: list[tuple[bytes, list[int]]], s: Search) -> Broadcast:
        phrases, items = zip(*piece)
        return spark.sparkContext.broadcast(Phrases.of(pa.table({"phrase": pa.array(phrases, pa.binary()), "items": pa.array(items, pa.list_(pa.int64()))}), s))

    def __iter__(self) -> Iterator[Phrases]:
        for piece in self.held:
            yield piece.value
            if len(self.held) > 1:  # it is read again from the worker's file the next time
                vars(piece).pop("_value", None)


def _phrases(docs: DataFrame, benchmark: DataFrame, s: Search) -> _Pieces:
    return _Pieces(docs.sparkSession, phrase_table(benchmark, s), s)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])


def spans(docs: DataFrame, benchmark: DataFrame, s: Search = Search()) -> DataFrame:
    """(doc_id, item_ids, spans, n_removed, clean_text) of every row that has a passage of the benchmark; spans are [start, end) in characters."""
    shared = _phrases(docs, benchmark, s)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _shards(batches, s):
            found = sorted(_matches(texts, shared, s).items())
            if found:
                at = [i for i, _ in found]
                yield pa.record_batch({
                    "doc_id": part.column("doc_id").take(pa.array(at)),
                    "item_ids": pa.array([items for _, (_, items) in found], pa.list_(pa.int64())),
                    "spans": pa.array([[{"start": a, "end": b} for a, b in x] for _, (x, _) in found], kind),
                    "n_removed": pa.array([sum(b - a for a, b in x) for _, (x, _) in found], pa.int64()),
                    "clean_text": pa.array([cut(texts[i], x) for i, (x, _) in found], pa.string()),
                })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_ids array<long>, spans array<struct<start:long,end:long>>, n_removed long, clean_text string")


def clean(docs: DataFrame, benchmark: DataFrame, s: Search = Search()) -> DataFrame:
    """``docs`` without the passages: spans are cut out of text (n_chars, if there, follows); a document of which no word is left goes."""
    shared = _phrases(docs, benchmark, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _shards(batches, s):
            found = _matches(texts, shared, s)
            if found:
                new = {i: cut(texts[i], x) for i, (x, _) in found.items()}
                left = dict(zip(new, kernel.Words(list(new.values())).counts().tolist()))
                names, columns = part.schema.names, list(part.columns)
                k = names.index("text")
                old = columns[k].to_pylist()
                columns[k] = pa.array([new.get(i, t) for i, t in enumerate(old)], columns[k].type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pa.array([len(new[i]) if i in new else x for i, x in enumerate(columns[k].to_pylist())], columns[k].type)
                part = pa.record_batch(columns, schema=part.schema).filter(pa.array([left.get(i, 1) > 0 for i in range(len(texts))]))
            yield part

    return docs.mapInArrow(run, docs.schema)
