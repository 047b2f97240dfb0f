"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked as the library marks it (a space in front, spaces as U+2581) and cut into *marked words*, which no piece
crosses: runs of marks with the characters that follow, and characters that no piece contains, each alone.  The distinct
words of a batch are sorted, so that they are the paths of a trie in depth-first order; a stack holds the forward scores of the
current path, and a word only computes those beyond its common prefix with the word before.

Of several marks in a row only the last can join a letter's piece; the others merge among themselves.  The lattice depends on the model.  Unigram: the best sum of scores of pieces.  BPE: a piece may follow another only if the merges
would leave the two side by side (``encode(a + b) == [a, b]``); then exactly one path reaches each position, the one
that the merges make, so the ids are those of the library.  Characters outside the vocabulary become byte pieces.

Defined results: an empty table gives no rows; very long texts are encoded whole; of paths of equal score the one whose last piece is shortest is
taken (BPE has one path only); null and empty texts have no ids; ``lossless`` is false only where the marks themselves (U+2581) occur in
the text, since decoding turns them into spaces; repeated rows are each encoded; other columns, whatever their names, are ignored; a null doc_id is an ordinary row.

Plan: one narrow scan, nothing is shuffled; words are shared within a task's batches and, in a bounded cache, across them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words that a Python worker keeps between batches; beyond it the cache starts anew.
CACHE_WORDS = 120_000


@dataclass
class Vocabulary:
    """What encoding needs of a model file."""

    pieces: list[str]
    scores: list[float]
    usable: list[bool]
    bytes_at: list[int]  # ids of the 256 byte pieces
    bpe: bool
    ids: dict[str, int] = field(init=False)
    backward: dict = field(init=False)  # trie of the reversed pieces; "" leads to a piece's id
    _rank: dict[int, int] | None = field(init=False, default=None)
    _parts: dict[int, tuple[int, int]] = field(init=False, default_factory=dict)
    runs: dict[int, int] = field(init=False)  # number of marks -> the piece of them
    _run_parts: list[list[int]] = field(init=False, default_factory=lambda: [[]])
    _pairs: dict[int, bool] = field(init=False, default_factory=dict)

    def __post_init__(self):
        every = {p: i for i, p in enumerate(self.pieces) if self.usable[i]}
        self.runs = {len(p): i for p, i in every.items() if not p.strip(MARK)}
        self.ids = {p: i for p, i in every.items() if len(p) == 1 or p.strip(MARK)}
        assert MARK in self.ids and not any(p.startswith(2 * MARK) for p in self.ids), "only pieces of marks alone may have several"
        assert not self.bpe or max((self.scores[i] for n, i in self.runs.items() if n > 1), default=-2e9) < min((self.scores[i] for p, i in self.ids.items() if len(p) > 1), default=0), "runs of marks must merge last"
        assert not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids), "pieces must not cross words"
        self.backward = {}
        for p, i in (self.ids if self.bpe else every).items():
            node = self.backward
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        assert [*sp.encode("a", out_type=str)][0].startswith(MARK), "the model must add a space in front"
        usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in every]
        at = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # a BPE model scores its pieces by their order, a unigram model by their log-probability
        scores = [sp.get_score(i) for i in every]
        merged = [s for s, p, u in zip(scores, map(sp.id_to_piece, every), usable) if u and len(p) > 1]
        return cls([sp.id_to_piece(i) for i in every], scores, usable, at, all(s == int(s) for s in merged))

    def _merge(self, text: str, last: bool = True) -> list[str]:
        """The library's merges, literally: the best-scored adjacent pair first, the leftmost of equals; ``last`` False: all but one."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0 or not last and len(parts) == 2:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _splits(self) -> None:
        """For each piece: its place among the merges, and the two parts its last merge joins (itself twice if a character)."""
        order = sorted(self.ids.values(), key=lambda i: (len(self.pieces[i]) > 1, -self.scores[i], i))
        self._rank = {i: k for k, i in enumerate(order)}
        self._parts = {}
        for i in order:
            parts = self._merge(self.pieces[i], last=False)
            self._parts[i] = (self.ids[parts[0]], self.ids[parts[-1]]) if len(parts) == 2 else (i, i)

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may come right after piece a: no merge across their border comes before those that make the two."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            known = self._pairs[key] = self._stays_apart(a, b)
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        if self._rank is None:
            self._splits()
        rank, parts, pieces, ids = self._rank, self._parts, self.pieces, self.ids
        limit = len(rank) + 1  # only merges before this one can have happened while a and b are at the border
        while True:
            both = ids.get(pieces[a] + pieces[b])
            if both is not None and rank[both] < limit:
                return False
            if rank[a] > rank[b]:  # undo the later of the merges that made the two neighbours
                right = parts[a][1]
                if right != a:
                    limit, a = rank[a], right
                    continue
                left = parts[b][0]
                if left == b:
                    return True
                limit, b = rank[b] + 1, left
            else:
                left = parts[b][0]
                if left != b:
                    limit, b = rank[b] + 1, left
                    continue
                right = parts[a][1]
                if right == a:
                    return True
                limit, a = rank[a], right

    def run(self, n: int) -> list[int]:
        """Ids of n marks that no letter claims."""
        if not self.bpe:
            return next(forward([n * MARK], self))
        while len(self._run_parts) <= n:  # all their merges score the same, so the leftmost comes first: the parts are a stack
            parts = [*self._run_parts[-1], 1]
            while len(parts) > 1 and parts[-2] + parts[-1] in self.runs:
                parts[-2:] = [parts[-2] + parts[-1]]
            self._run_parts.append(parts)
        return [self.runs[k] for k in self._run_parts[n]]

    def pattern(self) -> re.Pattern:
        return re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


def forward(words: list[str], v: Vocabulary) -> Iterator[list[int]]:
    """Ids of each of the sorted ``words``."""
    follows, scores, pieces, bpe, root, pairs = v.follows, v.scores, v.pieces, v.bpe, v.backward, v._pairs
    known = pairs.get
    last, score, before = [-1], [0.0], ""  # by length of the prefix: its last piece (-2 - code point: none has it) and score
    mark = v.ids[MARK]
    for word in words:
        more = 0
        if bpe and word.startswith(2 * MARK):  # marks that no letter claims merge after all else
            more = len(word) - len(word.lstrip(MARK)) - 1
            word = word[more:]
        n, same = len(word), 0
        for x, y in zip(before, word):
            if x != y:
                break
            same += 1
        before = word
        del last[same + 1 :], score[same + 1 :]
        for i in range(same + 1, n + 1):
            best, piece, node, j = None, -2 - ord(word[i - 1]), root, i
            while j:
                j -= 1
                node = node.get(word[j])
                if node is None:
                    break
                t = node.get("")
                if t is None:
                    continue
                if bpe:
                    p = last[j]
                    if p >= 0:
                        ok = known(p << 32 | t)
                        if not (follows(p, t) if ok is None else ok):
                            continue
                    best, piece = score[j] + scores[t], t
                    break  # the only one
                if best is None or score[j] + scores[t] > best:
                    best, piece = score[j] + scores[t], t
            last.append(piece)
            score.append(score[i - 1] if best is None else best)
        out = []
        while n:
            t = last[n]
            if t >= 0:
                out.append(t)
                n -= len(pieces[t])
            else:
                out += [v.bytes_at[b] for b in reversed(chr(-2 - t).encode())]
                n -= 1
        out.reverse()
        if more:
            out = v.run(more + 1) + out[1:] if out[0] == mark else v.run(more) + out
        yield out


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v, self.pattern = v, v.pattern()
        self.known: dict[str, list[int]] = {}
        byte_of = {i: bytes([b]) for b, i in enumerate(v.bytes_at)}
        self.raw = pa.array([byte_of.get(i, p.encode() if v.usable[i] else b"") for i, p in enumerate(v.pieces)], pa.large_binary())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and their bounds by text."""
        found, counts, find = [], np.zeros(len(texts), np.int64), self.pattern.findall
        for i, t in enumerate(texts):
            if t:
                words = find(MARK + t.replace(" ", MARK))
                counts[i] = len(words)
                found += words
        distinct = set(found)
        new = sorted(distinct - self.known.keys())
        fresh = dict(zip(new, forward(new, self.v)))
        order = {w: k for k, w in enumerate(distinct)}
        lists = [fresh[w] if w in fresh else self.known[w] for w in order]
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
        if len(fresh) <= CACHE_WORDS:
            self.known.update(fresh)
        del fresh
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
        at = np.fromiter(map(order.__getitem__, found), np.int64, len(found))
        starts, many = np.concatenate([[0], np.cumsum(sizes)])[at], sizes[at]
        stops = np.cumsum(many)
        ids = flat[np.repeat(starts - (stops - many), many) + np.arange(int(many.sum()))]
        bounds = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Text of each run of ids; ill-formed bytes become U+FFFD."""
        raw = self.raw.take(pa.array(ids, pa.int32()))
        if not len(raw):
            return [""] * (len(bounds) - 1)
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = raw.buffers()[2].to_pybytes() if raw.buffers()[2] else b""
        cuts = offsets[bounds]
        out = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            text = data[lo:hi].decode("utf-8", "replace").replace(MARK, " ")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One for a worker process and broadcast, so that later tasks find its words and pairs."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(shared.value)
    return _encoders[shared.id]


class _Shared:
    """A broadcast variable with the number that tells it apart inside a worker."""

    def __init__(self, spark, value):
        self.held = spark.sparkContext.broadcast(value)
        self.id = self.held._jbroadcast.id() if self.held._jbroadcast is not None else id(value)

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self):
        return self.held.value


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, lossless) of every row; lossless: decoding the ids gives the text."""
    shared = _Shared(docs.sparkSession, Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part, texts in kernel.slices(batch, limit=2 * kernel.SLICE_CHARS):
                ids, bounds = encoder.encode(texts)
                same = [x == y for x, y in zip(encoder.decode(ids, bounds), texts)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": lists, "n_tokens": np.diff(bounds), "lossless": pa.array(same, pa.bool_())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, lossless boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids): the way back; null ids give an empty text."""
    shared = _Shared(encoded.sparkSession, Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
            ids = np.fromiter((i for x in lists for i in x), np.int32, int(bounds[-1]))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(encoder.decode(ids, bounds), pa.string())})

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
