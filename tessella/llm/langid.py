"""Language identification with a string kernel.

Kernel: blended spectrum of character n-grams (n = 1 .. ``orders``), presence only,
``k(x, y) = |grams(x) & grams(y)| / sqrt(|grams(x)| |grams(y)|)`` over the n-grams that occur in the landmarks.
Texts are compared without case, everything but letters and marks being a space.  Nystroem features
``k(x, landmarks) K^(-1/2)`` feed one-versus-rest kernel ridge regression; whole documents are scored in
batches as two matrix products, presence x landmarks and kernel values x class weights.

All characters of the landmarks and all labelled languages take part.  n-grams are 64-bit codes (three code points fit into one), looked up in a hash table.

The classifier is fitted on a bounded sample of labelled rows: per language the ``sample`` (doc_id, lang) of smallest hash of doc_id, those of more than
``longest`` characters last, as long as they have no more than ``characters`` in all (the first always counts); the first ``landmarks`` of a language are its landmarks.
Texts of the sample are whole.  Scoring covers every document and its whole text.

Defined results: a text without a letter (null, empty, symbols) gets language ``und``, score and margin 0, and is rejected; a document is also rejected if it is
surely of another language than its ``lang`` says: the margin between the two best languages is at least ``sure``.  A null or unknown ``lang`` is never a
contradiction.  Ties go to the alphabetically first language; repeated rows are scored each time and are one labelled row (that of the smallest text if they differ);
very long texts are scored whole; with no labelled text at all everything is ``und``; an empty table gives no rows;
other columns, whatever their names, are ignored by :func:`identify` and passed on unread by :func:`accept`.

Plan: a scan of (doc_id, lang, length) picks the sample (top-k by window, pruned before its shuffle), a scan of the texts fetches
it through a join with its bounded list of ids, and one narrow scan scores; no other text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel


@dataclass(frozen=True)
class Settings:
    orders: int = 3
    sample: int = 240
    landmarks: int = 16
    ridge: float = 1e-2
    sure: float = 0.5
    #: characters of a labelled text beyond which it is taken last, and of all texts of a language.
    longest: int = 50_000
    characters: int = 2_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-cased letter, or a space."""
    table = np.where(kernel.fold_table() == 0, 32, kernel.fold_table()).astype(np.uint32)
    table[ord("0") : ord("9") + 1] = 32
    return table


_SHIFT = np.uint64(21)  # bits of a code point
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0)  # no n-gram has this code


def _codes(letters: np.ndarray, n: int) -> np.ndarray:
    """Codes of the n-grams that begin at each character but the last n - 1; of different n they differ."""
    here = len(letters) - n + 1
    out = letters[:here].copy()
    for k in range(1, n):
        if k == 3:  # beyond 63 bits: codes are hashes from here on
            out = kernel.finish(out + _MIX)
        out = (out << _SHIFT | letters[k : k + here]) if k < 3 else kernel.finish(out * _MIX + letters[k : k + here])
    return out


class Table:
    """Numbers of known n-gram codes: open addressing with room to spare, probed for many codes at once."""

    def __init__(self, codes: np.ndarray):
        self.shift = np.uint64(64 - max(8, int(len(codes) * 4).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.numbers = np.full(size, _NONE), np.full(size, -1, np.int32)
        todo, slot = np.arange(len(codes)), self._slot(codes)
        while len(todo):
            free = self.keys[slot[todo]] == _NONE
            self.keys[slot[todo[free]]] = codes[todo[free]]  # of several on one place the last wins
            won = self.keys[slot[todo]] == codes[todo]
            self.numbers[slot[todo[won]]] = todo[won]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) % size

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _MIX >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Number of each code, -1 of one that is not known."""
        slot = self._slot(codes)
        met = self.keys[slot]
        out = np.where(met == codes, self.numbers[slot], np.int32(-1))
        todo = np.flatnonzero((met != codes) & (met != _NONE))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % len(self.keys)
            met = self.keys[slot[todo]]
            same = met == codes[todo]
            out[todo[same]] = self.numbers[slot[todo[same]]]
            todo = todo[~same & (met != _NONE)]
        return out


@dataclass
class Model:
    languages: list[str]
    table: Table
    features: int
    landmarks: np.ndarray  # features x m, scaled by 1 / sqrt(|grams|)
    weights: np.ndarray  # m x languages
    settings: Settings

    def presence(self, texts: list[str]) -> np.ndarray:
        """float32 texts x features."""
        codes, offsets = kernel.codes_of(texts)
        letters = _letters()[codes].astype(np.uint64)
        out = np.zeros((len(texts), self.features + 1), np.float32)
        flat, owner = out.ravel(), np.repeat(np.arange(len(texts)) * (self.features + 1), np.diff(offsets))
        for n in range(1, self.settings.orders + 1):
            here = len(letters) - n + 1
            if here <= 0:
                break
            feature = self.table.find(_codes(letters, n))
            if n > 1:
                feature[owner[:here] != owner[n - 1 :]] = -1
            flat[owner[:here] + feature + 1] = 1  # column 0 takes what is no feature
        return out[:, 1:]

    def kernel_values(self, texts: list[str]) -> np.ndarray:
        x = self.presence(texts)
        return (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    def decide(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: none), its score, and its lead on the next."""
        best, top, lead = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if self.languages and not t.isspace() and t]
        step = max(1, (1 << 22) // (self.features + 1))
        for lo in range(0, len(some), step):
            at = some[lo : lo + step]
            scores = (self.kernel_values([texts[i] for i in at]) @ self.weights).astype(np.float64)
            order = np.sort(scores, axis=1)
            known = _has_letters([texts[i] for i in at])
            best[at] = np.where(known, scores.argmax(axis=1), -1)
            top[at] = np.where(known, order[:, -1], 0)
            lead[at] = np.where(known, order[:, -1] - (order[:, -2] if order.shape[1] > 1 else 0), 0)
        return best, top, lead


def _has_letters(texts: list[str]) -> np.ndarray:
    codes, offsets = kernel.codes_of(texts)
    seen = np.concatenate([[0], np.cumsum(_letters()[codes] != 32)])
    return seen[offsets[1:]] > seen[offsets[:-1]]


def fit(texts: list[str], labels: list[str], s: Settings) -> Model:
    """Deterministic for the same rows in the same order."""
    languages = sorted(set(labels))
    chosen = [i for lang in languages for i in [k for k, x in enumerate(labels) if x == lang][: s.landmarks]]
    found = [_codes(_letters()[kernel.codes_of([texts[i]])[0]].astype(np.uint64), n) for i in chosen for n in range(1, min(s.orders, len(texts[i])) + 1)]
    known = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    features = len(known)
    model = Model(languages, Table(known), features, np.zeros((features, 0), np.float32), np.zeros((0, len(languages)), np.float32), s)
    if not chosen:
        return model
    marks = model.presence([texts[i] for i in chosen])
    model.landmarks = (marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))).T.astype(np.float32)
    gram = model.kernel_values([texts[i] for i in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([model.kernel_values([t]) for t in texts]).astype(np.float64) @ root
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = 1 / np.maximum((y > 0).sum(axis=0), 1)  # languages weigh the same
    w = np.array([share[languages.index(x)] for x in labels])
    solved = np.linalg.solve(phi.T @ (phi * w[:, None]) + s.ridge * np.eye(phi.shape[1]), phi.T @ (y * w[:, None]))
    model.weights = (root @ solved).astype(np.float32)
    return model


def sample(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, lang, pick) of the labelled rows to fit on: at most ``sample`` of a language, and ``characters`` of all but the first."""
    labelled = docs.where("lang is not null and doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.length("text").alias("size"))
    order = Window.partitionBy("lang").orderBy(F.col("size") > s.longest, F.xxhash64("doc_id"), "doc_id", "size")
    once = labelled.groupBy("doc_id", "lang").agg(F.min("size").alias("size"))
    picked = once.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= s.sample)
    total = F.sum(F.col("size").cast("long")).over(Window.partitionBy("lang").orderBy("pick"))
    return picked.withColumn("total", total).where((F.col("total") <= s.characters) | (F.col("pick") == 1)).select("doc_id", "lang", "size", "pick")


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on the bounded sample; a labelled row is one with a non-null lang, doc_id and text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.length("text").alias("size"))
    picked = F.broadcast(sample(docs, s))  # at most ``sample`` ids a language: less than the model itself
    rows = texts.join(picked, ["doc_id", "lang", "size"]).groupBy("lang", "pick").agg(F.min("text").alias("text")).orderBy("lang", "pick").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], s)


def _decider(docs: DataFrame, s: Settings) -> Callable[[pa.RecordBatch, list[str]], tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, s))

    def decide(part: pa.RecordBatch, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        model: Model = shared.value
        best, top, lead = model.decide(texts)
        names = [model.languages[i] if i >= 0 else "und" for i in best]
        told = part.column("lang").to_pylist()
        known = set(model.languages)
        wrong = np.array([t in known and t != name for t, name in zip(told, names)], bool)
        return names, top, lead, (best >= 0) & ~(wrong & (lead >= s.sure))

    return decide


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, language, score, margin, keep) of every row."""
    decide = _decider(docs, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in kernel.slices(batch):
                names, top, lead, keep = decide(part, texts)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "language": pa.array(names, pa.string()), "score": top, "margin": lead, "keep": keep})

    return docs.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(run, "doc_id long, language string, score double, margin double, keep boolean")


def accept(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    decide = _decider(docs, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in kernel.slices(batch):
                yield part.filter(pa.array(decide(part, texts)[3]))

    return docs.mapInArrow(run, docs.schema)
