"""Language-model scoring with a hidden Markov model.

A document is one sequence of words (without case; marks and white space don't count).  Each distinct word of the corpus is a symbol of
its own (told apart by 64-bit hashes), and one more symbol stands for any word that the corpus doesn't have.
Baum-Welch trains ``states`` latent states on *every* document: each task runs the scaled forward and
backward recursions over its documents and emits expected counts; the counts are summed across partitions by word, and the
driver streams them into the next model.  Counts travel as integers of 2**-20 (transitions 2**-10), so their sums don't depend on the order of tasks.

The emission table grows with the distinct words.  It lies in the shared folder as two arrays, the sorted hashes and the rows in
their order, which workers map and of which they copy the rows of one run of documents; neither they nor the driver hold it whole.

The score of a document is its exact log-likelihood under the trained model, by the scaled forward recursion.  Sequences longer than
``segment`` symbols are cut for the recursion only: each segment's transfer matrix is multiplied out in lockstep with all
others, the matrices are chained, and so every position has the very forward and backward vectors that it would have without the cut.

Defined results: a null, empty or wordless text has 0 tokens, log-likelihood 0 and a null mean; it adds nothing to training; a repeated
row counts and is scored each time; a corpus without words, or an empty table, leaves the initial model (and gives no rows); very long texts are scored whole; there are no ties (a
text has one likelihood); other columns, whatever their names, are ignored.

Plan: at most ``rounds`` + 2 narrow scans of the texts; the first shuffles one row for each distinct word of a run of ``flush`` words, and
so does each round.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

#: Counts travel as integers: of words in 2**-20, of transitions, of which there are as many as words of the corpus, in 2**-10, so that sums fit into 64 bits.
_UNIT, _HEAD_UNIT = float(1 << 20), float(1 << 10)


@dataclass(frozen=True)
class Settings:
    states: int = 4
    #: top bits of a word's hash that choose its row of the initial model
    bits: int = 15
    #: rounds at most; training ends once a round raised the log-likelihood by less than this share of it
    rounds: int = 3
    tolerance: float = 1e-5
    #: added to every expected count
    smoothing: float = 0.1
    segment: int = 512
    #: words of one round of the recursions
    together: int = 400_000
    #: words after which a task emits its counts, which bounds what one row can hold
    flush: int = 1 << 21
    seed: int = 11


@dataclass
class Emission:
    """Rows of the corpus vocabulary in mapped files, indexed by word hash; the last row is that of unknown words."""

    words_at: str
    rows_at: str

    def __getstate__(self) -> dict[str, str]:
        return {"words_at": self.words_at, "rows_at": self.rows_at}

    @cached_property
    def words(self) -> np.ndarray:
        """Sorted hashes (no file of no words can be mapped)."""
        return np.memmap(self.words_at, np.int64, "r") if Path(self.words_at).stat().st_size else np.zeros(0, np.int64)

    @cached_property
    def rows(self) -> np.ndarray:
        return np.load(self.rows_at, mmap_mode="r")

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Row numbers."""
        n = len(self.words)
        at = np.searchsorted(self.words, hashes)
        return np.where((at < n) & (self.words[np.minimum(at, n - 1)] == hashes), at, n) if n else np.zeros_like(at)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        return self.rows[self.slots(hashes)]

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return np.array(self.rows, dtype)


@dataclass
class Model:
    initial: np.ndarray  # states
    transition: np.ndarray  # states x states
    emission: np.ndarray | Emission  # symbols x states

    @classmethod
    def start(cls, s: Settings) -> Model:
        random = np.random.default_rng(s.seed)
        size = 1 << s.bits

        def rows(*shape: int) -> np.ndarray:
            x = 1 + random.random(shape)
            return x / x.sum(axis=-1, keepdims=True)

        return cls(rows(s.states), rows(s.states, s.states), np.ascontiguousarray(rows(s.states, size).T))

    def part(self, symbols: np.ndarray) -> tuple[Model, np.ndarray, np.ndarray]:
        """The model of the words that occur in ``symbols``, the symbols in it, and the row numbers of its words."""
        words, local = _distinct(symbols)
        slots = self.emission.slots(words)
        return Model(self.initial, self.transition, np.array(self.emission.rows[slots])), local, slots


@dataclass
class Counts:
    initial: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    likelihood: float = 0.0

    @classmethod
    def none(cls, s: Settings) -> Counts:
        return cls(np.zeros(s.states), np.zeros((s.states, s.states)), np.zeros((1 << s.bits, s.states)))


def _distinct(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with its inverse, but only the distinct symbols are sorted."""
    local, words = pd.factorize(symbols)
    order = np.argsort(words)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return words[order], rank[local]


def symbols_of(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the bounds of the texts."""
    words = kernel.Words(texts)
    return kernel.finish(words.raw).view(np.int64), words.bounds


def _sequences(batches: Iterator[pa.RecordBatch], s: Settings, ids: bool) -> Iterator[tuple[pa.Array | None, np.ndarray, np.ndarray]]:
    """(doc_ids, symbols, bounds) of runs of documents of about ``together`` words."""
    held: list[tuple[pa.Array | None, np.ndarray, np.ndarray]] = []

    def joined() -> tuple[pa.Array | None, np.ndarray, np.ndarray]:
        counts = np.concatenate([np.diff(b) for _, _, b in held])
        return pa.concat_arrays([d for d, _, _ in held]) if ids else None, np.concatenate([x for _, x, _ in held]), np.concatenate([[0], np.cumsum(counts)])

    for batch in batches:
        for part, texts in kernel.slices(batch):
            held.append((part.column("doc_id") if ids else None, *symbols_of(texts, s)))
            if sum(len(x) for _, x, _ in held) >= s.together:
                yield joined()
                held.clear()
    if held:
        yield joined()


class Recursion:
    """Forward (and backward) vectors of several sequences at once, one segment a lane."""

    def __init__(self, model: Model, symbols: np.ndarray, bounds: np.ndarray, segment: int):
        self.model, self.symbols = model, symbols
        counts = np.diff(bounds)
        self.owners = np.flatnonzero(counts)  # sequences with a symbol
        pieces = -(-counts[self.owners] // segment)
        self.sequence = np.repeat(np.arange(len(self.owners)), pieces)
        order = np.arange(len(self.sequence)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.first, self.last = order == 0, np.concatenate([order[1:] == 0, [True]]) if len(order) else np.zeros(0, bool)
        self.begin = bounds[:-1][self.owners][self.sequence] + order * segment
        self.size = np.minimum(bounds[1:][self.owners][self.sequence] - self.begin, segment)
        self.lanes = np.argsort(-self.size, kind="stable")  # longest first: the lanes still alive are a prefix
        self.ends = np.searchsorted(-self.size[self.lanes], -np.arange(segment), side="left")  # lanes longer than t
        self.seen = model.emission[symbols]  # n x states

    def _alive(self) -> Iterator[tuple[int, np.ndarray]]:
        for t in range(len(self.ends)):
            if not self.ends[t]:
                return
            yield t, self.lanes[: self.ends[t]]

    def _links(self) -> np.ndarray:
        """Transfer matrix (vector in, vector out), up to a factor, of each segment of a sequence that has several."""
        k = len(self.model.initial)
        matrix = np.broadcast_to(np.eye(k), (len(self.begin), k, k)).copy()
        need = ~(self.first & self.last)
        for t, lanes in self._alive():
            lanes = lanes[need[lanes]]
            if not len(lanes):
                break
            m = matrix[lanes]
            if t:
                m = m @ self.model.transition
            else:
                m = np.where(self.first[lanes][:, None, None], m, m @ self.model.transition)
            m *= self.seen[self.begin[lanes] + t][:, None, :]
            matrix[lanes] = m / m.sum(axis=(1, 2), keepdims=True)
        return matrix

    def forward(self) -> np.ndarray:
        """Scaled forward vectors by symbol; ``self.scales`` holds p(symbol | those before it)."""
        n, k = len(self.symbols), len(self.model.initial)
        self.enter = np.zeros((len(self.begin), k))  # normalised forward vector before each segment
        self.enter[self.first] = self.model.initial
        if not self.last.all():
            self.matrix = self._links()
            for lane in np.flatnonzero(~self.first):  # the chain over a sequence's few segments
                v = self.enter[lane - 1] @ self.matrix[lane - 1]
                self.enter[lane] = v / v.sum()
        alpha, self.scales = np.empty((n, k)), np.empty(n)
        state = self.enter[self.lanes]
        for t, lanes in self._alive():
            m = len(lanes)
            at = self.begin[lanes] + t
            v = state[:m] @ self.model.transition
            if not t:
                v = np.where(self.first[lanes][:, None], state[:m], v)
            v *= self.seen[at]
            c = v.sum(axis=1)
            v /= c[:, None]
            state[:m] = v
            alpha[at], self.scales[at] = v, c
        return alpha

    def likelihood(self, sequences: int) -> np.ndarray:
        """Log-likelihood of each sequence (0 of an empty one)."""
        out = np.zeros(sequences)
        if len(self.owners):
            self.forward()
            out[self.owners] = np.add.reduceat(np.log(self.scales), self.begin[self.first])
        return out

    def expect(self, into: Counts) -> float:
        """Add expected counts; returns the log-likelihood of all sequences."""
        if not len(self.owners):
            return 0.0
        alpha = self.forward()
        k = alpha.shape[1]
        after = np.ones((len(self.begin), k))  # backward vector at the end of each segment, up to a factor
        if not self.last.all():
            for lane in np.flatnonzero(~self.last)[::-1]:
                # the segment behind (its matrix holds its own transitions, the first into it included), then what follows that
                v = self.matrix[lane + 1] @ after[lane + 1]
                after[lane] = v / v.sum()
        beta = np.empty_like(alpha)
        size = self.size[self.lanes]
        state = after[self.lanes]
        for t in range(len(self.ends) - 1, -1, -1):
            m = self.ends[t]
            if not m:
                continue
            lanes = self.lanes[:m]
            at = self.begin[lanes] + t
            inner = size[:m] > t + 1
            v = state[:m]
            if inner.any():
                nxt = at[inner] + 1
                v[inner] = (v[inner] * self.seen[nxt]) @ self.model.transition.T
            v /= np.einsum("ij,ij->i", alpha[at], v)[:, None]  # so that alpha * beta sums to 1
            state[:m] = v
            beta[at] = v
        gamma = alpha * beta
        for i in range(k):
            into.emission[:, i] += np.bincount(self.symbols, weights=gamma[:, i], minlength=len(into.emission))
        heads = self.begin[self.first]
        into.initial += gamma[heads].sum(axis=0)
        inner = np.ones(len(alpha), bool)
        inner[heads] = False
        at = np.flatnonzero(inner)
        into.transition += self.model.transition * (alpha[at - 1].T @ (self.seen[at] * beta[at] / self.scales[at][:, None]))
        return float(np.log(self.scales).sum())


def _folder(docs: DataFrame) -> str:
    """A new folder that driver and workers share."""
    kernel.shared_checkpoints(docs.sparkSession)
    path = Path(docs.sparkSession.sparkContext.getCheckpointDir().removeprefix("file:"), f"hmm-{uuid.uuid4().hex}")
    path.mkdir(parents=True)
    return str(path)


def vocabulary(docs: DataFrame, s: Settings, folder: str) -> Emission:
    """The initial emission table of all distinct words; the driver writes it part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, symbols, _ in _sequences(batches, s, ids=False):
            held.append(np.sort(pd.unique(symbols)))
            n += len(symbols)
            if n >= s.flush:
                yield pa.record_batch({"word": np.unique(np.concatenate(held))})
                held, n = [], 0
        if n:
            yield pa.record_batch({"word": np.unique(np.concatenate(held))})

    docs.where("text is not null").select("text").mapInArrow(run, "word long").distinct().orderBy("word").write.parquet(f"file://{folder}/vocabulary")
    emission = Emission(f"{folder}/words", f"{folder}/start.npy")
    with open(emission.words_at, "wb") as out:
        for path in sorted(Path(folder, "vocabulary").glob("*.parquet")):  # parts are in order
            for batch in ds.dataset(path).to_batches():
                out.write(batch.column("word").to_numpy().tobytes())
    start, size = Model.start(s).emission, len(emission.words) + 1
    rows = np.lib.format.open_memmap(emission.rows_at, "w+", np.float64, (size, s.states))
    for lo in range(0, size - 1, 1 << 20):
        words = emission.words[lo : lo + (1 << 20)]
        rows[lo : lo + len(words)] = start[words.view(np.uint64) >> np.uint64(64 - s.bits)]
    rows[-1] = start.mean(axis=0)
    _normalise(rows)
    return emission


def _normalise(rows: np.ndarray) -> None:
    total = sum(rows[lo : lo + (1 << 20)].sum(axis=0) for lo in range(0, len(rows), 1 << 20))
    for lo in range(0, len(rows), 1 << 20):
        rows[lo : lo + (1 << 20)] /= total
    rows.flush()


def counts(docs: DataFrame, model: Model, s: Settings) -> DataFrame:
    """(slot, c0 ..): expected counts over all documents; slots from 0 are rows of the emission table, -1 the initial state, -2 - i the
    transitions out of i, and the last the log-likelihood under ``model``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(s.states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for _, symbols, bounds in _sequences(batches, s, ids=False):
            model, local, slots = shared.value.part(symbols)
            total = Counts(np.zeros(s.states), np.zeros((s.states, s.states)), np.zeros((len(slots), s.states)))
            total.likelihood = Recursion(model, local, bounds, s.segment).expect(total)
            held.append((slots, total))
            words += len(symbols)
            if words >= s.flush:
                yield _rows(held, names)
                held, words = [], 0
        if words:
            yield _rows(held, names)

    sums = [F.sum(c).alias(c) for c in names]
    return docs.where("text is not null").select("text").mapInArrow(run, "slot long, " + ", ".join(f"{c} long" for c in names)).groupBy("slot").agg(*sums)


def _rows(held: list[tuple[np.ndarray, Counts]], names: list[str]) -> pa.RecordBatch:
    some, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    values = np.concatenate([c.emission for _, c in held])
    emission = np.stack([np.bincount(at, values[:, i], len(some)) for i in range(len(names))], axis=1)
    likelihood = np.zeros((1, len(names)))
    likelihood[0, 0] = sum(c.likelihood for _, c in held)
    heads = np.concatenate([sum(c.initial for _, c in held)[None], sum(c.transition for _, c in held), likelihood])
    table = np.rint(np.concatenate([emission * _UNIT, heads * _HEAD_UNIT])).astype(np.int64)
    slots = np.concatenate([some, -1 - np.arange(len(names) + 2)]).astype(np.int64)
    return pa.record_batch({"slot": slots, **{n: table[:, i] for i, n in enumerate(names)}})


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    folder, first = _folder(docs), Model.start(s)
    model = Model(first.initial, first.transition, vocabulary(docs, s, folder))
    if not len(model.emission.words):
        return model
    before = None
    for k in range(s.rounds):
        counts(docs, model, s).write.parquet(f"file://{folder}/counts-{k}")
        rows = np.lib.format.open_memmap(f"{folder}/{k}.npy", "w+", np.float64, (len(model.emission.words) + 1, s.states))
        rows[:] = s.smoothing
        heads = np.full((s.states + 2, s.states), s.smoothing)
        heads[-1] = 0
        for batch in ds.dataset(f"{folder}/counts-{k}", format="parquet").to_batches():
            slot = batch.column("slot").to_numpy()
            values = np.stack([batch.column(f"c{i}").to_numpy() for i in range(s.states)], axis=1)
            rows[slot[slot >= 0]] += values[slot >= 0] / _UNIT
            heads[-1 - slot[slot < 0]] += values[slot < 0] / _HEAD_UNIT
        _normalise(rows)
        Path(model.emission.rows_at).unlink()
        *heads, (now, *_) = heads
        heads = np.array(heads)
        model = Model(heads[0] / heads[0].sum(), heads[1:] / heads[1:].sum(axis=1, keepdims=True), Emission(model.emission.words_at, f"{folder}/{k}.npy"))
        if before is not None and now - before < s.tolerance * abs(before):
            break
        before = now
    return model


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every row, under a model trained on all of them."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, symbols, bounds in _sequences(batches, s, ids=True):
            n = np.diff(bounds)
            model, local, _ = shared.value.part(symbols)
            total = Recursion(model, local, bounds, s.segment).likelihood(len(n))
            yield pa.record_batch({"doc_id": ids, "n_tokens": n, "log_likelihood": total, "mean_log_likelihood": pa.array(total / np.maximum(n, 1), mask=n == 0)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")
