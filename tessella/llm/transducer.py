"""Exact token counts by a tokenizer compiled to a deterministic finite-state transducer.

A transition's annotation is how many tokens more (or fewer) the text read so far has once the symbol is read; a document's
count is the sum along its path.  A state holds what decides the future and nothing else: the longest suffix of the
text that some longer piece begins with, and for each of its positions that can still begin a piece the last piece before it and its
count relative to now.  So there are finitely many states, however long the text; they are compiled when a text first
needs them, into dense arrays that are walked by table look-up.

Text is cut into chunks of ``chunk`` symbols, which are walked in lockstep.  A chunk is a map from the state before it to the state after it.  Reading a
space, or a character outside the vocabulary, leads to one state whatever came before, so most chunks are constant maps.  Of the others (text without
spaces) the maps are tabulated for the states that can reach them: the end state of a constant chunk on the left, or what the left chunk's own table leads
to, and at first the start state, from which a walk falls into step with the true one after a few symbols.  Chunks of the same symbols share a table.  Once no table leads to a state that the next
lacks, the tables are composed by pointer doubling, a prefix scan in a logarithmic number of steps, which gives each chunk its true state before it.

Defined results: null and empty texts have 0 tokens; repeated rows are each counted; a null doc_id is an ordinary row; other columns are ignored,
whatever their names; very long texts are cut like all others, none is skipped or shortened, with or without spaces; there are no ties (a text has one count);
an empty table gives no rows.

Plan: one narrow scan, no shuffle, two numbers out for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .pieces import MARK, MODEL, Vocabulary, _Shared

#: Symbols in a chunk.
CHUNK = 256
#: Cells of the transition table after which a worker forgets it (between slices) and compiles anew.
TABLE_CELLS = 25_000_000

_UNUSED = -1
#: Symbols below this lead to one state each: 1 .. 4 a character of so many byte pieces; from _MARKS on a mark by which the
#: run of marks it ends gets 1, 0, -1 .. more pieces.
_FIXED, _MARKS = 24, 5


_LOW = 0xFFFFFFFF


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1 .. of each start, ``many`` of them."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())


class Machine:
    """The transducer of a vocabulary, compiled as far as it was walked."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.longer: dict[str, list[int]] = {}  # proper prefix of a piece -> the pieces it begins
        for p, i in v.ids.items():
            for k in range(1, len(p)):
                self.longer.setdefault(p[:k], []).append(i)
        self.seen: dict[tuple, int | None] = {}
        self.characters = np.full(0x110000, -1, np.int32)  # 0: a piece, not met yet; above: its symbol
        self.characters[[ord(p) for p in v.ids if len(p) == 1]] = 0
        self.reset()

    def reset(self) -> None:
        self.characters[self.characters > 0] = 0
        self.symbols = [""] * _FIXED
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.to = np.full((1024, 64), -1, np.int32)
        self.gain = np.zeros((1024, 64), np.int8)
        self.fixed_to = np.zeros(_FIXED, np.int32)
        self.fixed_gain = np.array([0, 1, 2, 3, 4, *range(1, 1 - _FIXED + _MARKS, -1)], np.int8)
        keys = [("", (None,), (0,))] * _MARKS + [(MARK, (None, self.v.ids[MARK]), (-int(g), 0)) for g in self.fixed_gain[_MARKS:]]
        for k, key in enumerate(keys):
            self.fixed_to[k] = self._state(key)
        self.start = int(self.fixed_to[0])
        self.to[: len(self.states), :_FIXED] = self.fixed_to
        # by the length of a run of marks: the symbol of its last
        self.run_pieces, self.run_symbols = [0], np.zeros(1, np.int32)

    def _state(self, key: tuple) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
            if n == len(self.to):
                longer = ((0, n // 2), (0, 0))
                self.to, self.gain = np.pad(self.to, longer, constant_values=-1), np.pad(self.gain, longer)
            self.to[n, :_FIXED], self.gain[n, :_FIXED] = self.fixed_to, self.fixed_gain
        return n

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        suffix, lasts, since = self.states[state]
        ids, follows, longer = self.v.ids, self.v.follows, self.longer
        text = suffix + c
        for k, p in enumerate(lasts):
            if p != _UNUSED and (t := ids.get(text[k:])) is not None and (p is None or follows(p, t)):
                break
        else:
            raise AssertionError(f"no piece ends after {text!r}")
        gained = 1 + since[k]
        lasts, since, first = [*lasts, t], [*(x - gained for x in since), 0], -1
        for m in range(len(text)):
            if (p := lasts[m]) != _UNUSED and text[m:] in longer and (p := self._before(p, text[m:])) != _UNUSED:
                lasts[m] = p
                first = m if first < 0 else first
            else:
                lasts[m], since[m] = _UNUSED, 0
        first = len(text) if first < 0 else first
        return self._state((text[first:], tuple(lasts[first:]), tuple(since[first:]))), gained

    def _before(self, p: int | None, prefix: str) -> int | None:
        """p, or what is like it before ``prefix``: None if every piece of that prefix may follow it, _UNUSED if none may."""
        if p is None or len(pieces := self.longer[prefix]) > 100:
            return p
        if (key := (p, prefix)) not in self.seen:
            may = {self.v.follows(p, t) for t in pieces}
            self.seen[key] = p if len(may) > 1 else None if may.pop() else _UNUSED
        return self.seen[key]

    def _learn(self, cells: np.ndarray) -> None:
        width = self.to.shape[1]
        for cell in np.unique(cells).tolist():
            state, symbol = divmod(cell, width)
            self.to[state, symbol], self.gain[state, symbol] = self._compile(state, self.symbols[symbol])

    def _stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all non-empty texts end to end, and their bounds by text."""
        codes, bounds = kernel.codes_of([MARK + t.replace(" ", MARK) if t else "" for t in texts])
        symbols = self.characters[codes]
        if (new := codes[symbols == 0]).size:
            for code in np.unique(new).tolist():
                self.characters[code] = len(self.symbols)
                self.symbols.append(chr(code))
            while len(self.symbols) > self.to.shape[1]:
                wider = ((0, 0), (0, 32))
                self.to, self.gain = np.pad(self.to, wider, constant_values=-1), np.pad(self.gain, wider)
            symbols = self.characters[codes]
        at = np.flatnonzero(codes == ord(MARK))
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.diff(at) > 1
        head = np.zeros(len(codes) + 1, bool)
        head[bounds] = True
        fresh |= head[at]
        length = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0)) + 1
        while len(self.run_pieces) <= length.max(initial=0):
            self.run_pieces.append(len(self.v.run(len(self.run_pieces))))
        if len(self.run_symbols) < len(self.run_pieces):
            self.run_symbols = _MARKS + 1 - np.diff(self.run_pieces, prepend=0).astype(np.int32)
        symbols[at] = self.run_symbols[length]
        other = symbols < 0
        symbols[other] = 1 + (codes[other] >= 0x80) + (codes[other] >= 0x800) + (codes[other] >= 0x10000)
        return symbols, bounds

    def _walk(self, symbols: np.ndarray, states: np.ndarray, at: np.ndarray, stop: np.ndarray, gains: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """End states of the lanes, each from its state over symbols [at, stop), and the sums of the annotations, which are also written to ``gains``."""
        end, lane, total = states.copy(), np.flatnonzero(at < stop), np.zeros(len(states), np.int64)
        states, at, stop = states[lane], at[lane], stop[lane]
        while len(lane):
            cells = states * np.int64(self.to.shape[1]) + symbols[at]
            following = self.to.ravel()[cells]
            if (miss := following < 0).any():
                self._learn(cells[miss])
                following = self.to.ravel()[cells]
            gain = self.gain.ravel()[cells]
            if gains is None:
                total[lane] += gain
            else:
                gains[at] = gain
            states, at = following, at + 1
            if (over := at == stop).any():
                end[lane[over]] = states[over]
                on = ~over
                lane, states, at, stop = lane[on], states[on], at[on], stop[on]
        return end, total

    def _scan(self, symbols: np.ndarray, begin: np.ndarray, stop: np.ndarray, end: np.ndarray, gains: np.ndarray) -> None:
        """End states and annotations of the chunks without an end state, whose maps depend on the state before them."""
        open_ = np.flatnonzero(end < 0)
        if not len(open_):
            return
        left = end[open_ - 1]  # a text's first symbol leads to one state, so there is a chunk on the left
        padded = np.append(symbols, np.full(-len(symbols) % CHUNK, -1, symbols.dtype)).reshape(-1, CHUNK)[open_]
        _, model, kind = np.unique(padded.view(f"V{padded.itemsize * CHUNK}").ravel(), return_index=True, return_inverse=True)  # like chunks share a table
        follows = np.flatnonzero(np.diff(open_) == 1)
        pairs = np.unique(kind[follows] << 32 | kind[follows + 1])
        before, after = pairs >> 32, pairs & _LOW
        need = np.unique(kind << 32 | np.where(left >= 0, left, self.start))
        keys, exits, sums = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(need):
            chunk = open_[model[need >> 32]]
            to, total = self._walk(symbols, (need & _LOW).astype(np.int32), begin[chunk], stop[chunk], None)
            to = to.astype(np.int64)
            new = np.unique(need >> 32 << 32 | to)
            keys, exits, sums = (np.concatenate(x) for x in ((keys, need), (exits, to), (sums, total)))
            order = np.argsort(keys)
            keys, exits, sums = keys[order], exits[order], sums[order]
            lo, hi = np.searchsorted(before, new >> 32), np.searchsorted(before, new >> 32, side="right")
            need = np.unique(after[_ranges(lo, hi - lo)] << 32 | np.repeat(new & _LOW, hi - lo))
            need = need[keys[np.minimum(np.searchsorted(keys, need), len(keys) - 1)] != need]
        # the table of each chunk, and where each of its entries is in that of the next
        lo, hi = np.searchsorted(keys, kind << 32), np.searchsorted(keys, kind + 1 << 32)
        at, chunk = _ranges(lo, hi - lo), np.repeat(open_, hi - lo)
        exits, sums, keys = exits[at], sums[at], chunk << 32 | keys[at] & _LOW
        onward = np.minimum(np.searchsorted(keys, chunk + 1 << 32 | exits), len(keys) - 1)
        onward = np.where(np.append(end < 0, False)[chunk + 1], onward, np.arange(len(keys)))
        heads = np.flatnonzero(left >= 0)
        size = np.diff(np.append(heads, len(open_)))
        place = np.repeat(np.searchsorted(keys, open_[heads] << 32 | left[heads]), size)
        steps = np.arange(len(open_)) - np.repeat(heads, size)
        while steps.any():
            place = np.where(steps & 1, onward[place], place)
            onward, steps = onward[onward], steps >> 1
        end[open_] = exits[place]
        gains[begin[open_]] = sums[place]

    def count(self, texts: list[str]) -> np.ndarray:
        if self.to.size > TABLE_CELLS:
            self.reset()
        symbols, bounds = self._stream(texts)
        out = np.zeros(len(texts), np.int64)
        if not len(symbols):
            return out
        gains = np.zeros(len(symbols), np.int32)
        begin = np.arange(0, len(symbols), CHUNK)
        stop = np.minimum(begin + CHUNK, len(symbols))
        fixed = np.flatnonzero(symbols < _FIXED)  # symbols that lead to one state
        first = fixed[np.minimum(np.searchsorted(fixed, begin), len(fixed) - 1)]
        first = np.where((first >= begin) & (first < stop), first, stop)
        constant = first < stop
        start = np.full(len(begin), self.start, np.int32)
        # the constant part of each chunk's map
        end = np.where(constant, self._walk(symbols, start, first, stop, gains)[0], -1).astype(np.int32)
        self._scan(symbols, begin, stop, end, gains)
        # what comes before the constant part, from the end state of the chunk to the left
        todo = np.flatnonzero(constant & (first > begin))
        self._walk(symbols, end[todo - 1], begin[todo], first[todo], gains)
        some = np.flatnonzero(np.diff(bounds))
        out[some] = np.add.reduceat(gains, bounds[some])
        return out


_machines: dict[int, Machine] = {}


def _machine(shared: _Shared) -> Machine:
    if shared.id not in _machines:
        _machines.clear()
        _machines[shared.id] = Machine(shared.value)
    return _machines[shared.id]


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens) of every row: as many as the model's own encoder makes of the text."""
    shared = _Shared(docs.sparkSession, Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared)
        for batch in batches:
            for part, texts in kernel.slices(batch):
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_tokens": machine.count(texts)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")
