"""Jaccard self-join of documents on word n-grams with signature trees.

Two texts are *linked* if their sets of word n-grams (``n`` consecutive words without case; a text of fewer words has one gram, of
them all) differ and have a Jaccard index of at least ``threshold``.  Texts of equal sets are *copies*.  The result has one row for each
document: its class (all that chains of links and copies reach), how many copies it has and to how many different texts it is linked.

How it scales:

1. One scan gives each document a 128-bit fingerprint of its set, the set's size, a signature (a bitmap of its hashed grams) and ``bands`` MinHash keys.
   Documents of equal fingerprint are copies; only one of them goes on.  Keys travel packed, by run of documents, to the shards that own
   them; a shard finds the lists of texts that share a key.  Lists of the same texts count once.
2. Each list of up to ``most`` texts is a **signature tree**: nodes hold the OR of their children's bitmaps, the range of their sizes and
   the largest collision slack (size minus bits).  A pair of nodes (A, B) can't hold a link if ``popcount(A & B) + slack`` of either
   side is below ``threshold / (1 + threshold) * (min|A| + min|B|)`` or the size ranges are too far apart; the dual traversal drops it
   with all beneath it.  What is left is joined into components (a spanning forest of each list travels, never its pairs), so that texts that
   only share a passage don't chain others.  A longer list is not cut: all of its texts are put into one component.
3. The sets of texts in components of at least two are fetched, and a component's tree is joined with itself, now with exact
   comparison of what the bounds leave.  Components of more than ``block`` texts are cut into blocks by a hash, whose OR bitmaps and size ranges are the
   upper nodes of the tree: block pairs are pruned the same way first, and only surviving ones are brought together.  Counts
   of links and a spanning forest come out, so results grow with the documents even where links are quadratic in a group.

Two texts of Jaccard index J share a key with probability ``1 - (1 - J**rows)**bands``: 0.99998 at 0.55 with the defaults, more above, and more
through others of their component, as whole components are searched.  Signatures alone can't route texts: nodes of many unlike texts have
full bitmaps, so all pairs of nodes of a corpus would be met.  (An exact route, by the rarest grams of each set, was measured and left: see the README.)

Defined results: null, empty and wordless texts have no gram and are classes of their own, as are rows without a similar one; rows of
null doc_id are left out; every other row gives a row, so rows of one doc_id are told apart by their texts alone; copies among rows of one doc_id count
as copies; class_id and text_id are the smallest doc_id of the class and of the copies, so ties don't arise; very long texts are taken whole; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel


@dataclass(frozen=True)
class Join:
    n: int = 3
    threshold: float = 0.55
    #: texts brought together at once; larger components are joined block pair by block pair.
    block: int = 2048
    leaf: int = 4
    fanout: int = 4
    bands: int = 60
    rows: int = 3
    #: bits of the signatures by which lists are pruned.
    bits: int = 2048
    #: texts of a list up to which its own tree decides who is linked; of these, up to which all are compared at once.
    most: int = 1024
    few: int = 24
    #: words of a run, after which a task emits its keys.
    flush: int = 1 << 21
    #: keys that a shard holds at once, about.
    shard: int = 1 << 22


# -- step 1: fingerprints, signatures, keys ------------------------------------------------------


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1 .. of each start, ``many`` of them."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())


def _sets_of(texts: list[str], j: Join) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of each text, sorted, end to end, and their bounds."""
    h, bounds = kernel.ngrams(kernel.Words(texts), j.n, short=True)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h[lo:hi].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][bounds[:-1] < len(h)]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def _fingerprints(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.add.reduceat(h, at), np.add.reduceat(kernel.finish(h * np.uint64(0x2545F4914F6CDD1D)), at)


_SCAN = "doc_id long, f1 long, f2 long, size long, map binary, shard long, keys binary, texts binary, sizes binary"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("size", pa.int64()), ("map", pa.binary()), ("shard", pa.int64()), ("keys", pa.binary()), ("texts", pa.binary()), ("sizes", pa.binary())])


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([columns.get(f.name, pa.nulls(n, f.type)) for f in _FIELDS], schema=_FIELDS)


def _scan(docs: DataFrame, shards: int, j: Join) -> DataFrame:
    """Rows of documents (doc_id, f1, f2, size, map), of which those without a gram have size 0, and packed keys of the distinct texts of a
    run (shard, keys, texts, sizes); a key is 32 bits below those that choose its shard."""
    bits = shards.bit_length() - 1

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        text, keys = (np.concatenate(x) for x in zip(*held))
        text, once = np.unique(text, return_index=True)  # copies of a run go once
        keys, of = keys[once].ravel(), np.repeat(np.arange(len(text)), j.bands)
        shard, low = (keys >> np.uint64(64 - bits)).astype(np.int64), (keys >> np.uint64(32 - bits)).astype(np.uint32)
        order = np.argsort(shard, kind="stable")
        shard, of, low = shard[order], of[order], low[order]
        out, edges = [], np.searchsorted(shard, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            owners, sizes = np.unique(of[edges[s] : edges[s + 1]], return_counts=True)
            out.append((s, low[edges[s] : edges[s + 1]].tobytes(), text[owners].tobytes(), sizes.astype(np.uint32).tobytes()))
        return _rows(**{n: pa.array(c, _FIELDS.field(n).type) for n, c in zip(("shard", "keys", "texts", "sizes"), zip(*out))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(7)
        factors = random.integers(1 << 31, 1 << 32, j.bands * j.rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        masks = random.integers(0, 1 << 32, j.bands * j.rows, dtype=np.uint64).astype(np.uint32)
        held, words = [], 0
        for batch in batches:
            for part, texts in kernel.slices(batch):
                h, bounds = _sets_of(texts, j)
                sizes, ids = np.diff(bounds), part.column("doc_id")
                bare = ids.take(pa.array(np.flatnonzero(sizes == 0)))
                yield _rows(doc_id=bare, size=pa.array(np.zeros(len(bare), np.int64)))
                some = np.flatnonzero(sizes)
                if not len(some):
                    continue
                at, sizes = bounds[some], sizes[some]
                f1, f2 = _fingerprints(h, at)
                maps = _bitmaps((h & np.uint64(j.bits - 1)).astype(np.int64), np.repeat(np.arange(len(some)), sizes), len(some), j.bits)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(j.bits // 8), len(some), [None, pa.py_buffer(maps)]).cast(pa.binary())
                yield _rows(doc_id=ids.take(pa.array(some)), f1=pa.array(f1.view(np.int64)), f2=pa.array(f2.view(np.int64)), size=pa.array(sizes), map=raw)
                low, keys = (h >> np.uint64(16)).astype(np.uint32), np.empty((len(some), j.bands), np.uint64)
                for b in range(j.bands):
                    key = np.full(len(some), b + 1, np.uint64)
                    for k in range(b * j.rows, (b + 1) * j.rows):
                        key = kernel.finish(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((low ^ masks[k]) * factors[k], at))
                    keys[:, b] = key
                held.append((f1, keys))
                words += len(h)
                if words >= j.flush:
                    yield packed(held)
                    held, words = [], 0
        if held:
            yield packed(held)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCAN)


def _lists(packed: DataFrame, j: Join) -> DataFrame:
    """(list, a, b): the members ``a`` of each list of texts that share a key; of lists beyond ``most`` (list null) each text and the least."""

    def run(rows: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        keys, text = join("keys", np.uint32), np.repeat(join("texts", np.uint64), join("sizes", np.uint32))
        order = np.argsort(keys, kind="stable")
        keys, text = keys[order], text[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        twice = ~new | np.concatenate([~new[1:], [False]])  # a key that one entry alone has makes no list
        keys, text = keys[twice], text[twice]
        order = np.lexsort((text, keys))
        keys, text = keys[order], text[order]
        same = np.zeros(len(keys), bool)
        same[1:] = (keys[1:] == keys[:-1]) & (text[1:] == text[:-1])
        keys, text = keys[~same], text[~same]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        many = np.diff(np.concatenate([at, [len(keys)]]))
        at, many = at[many > 1], many[many > 1]
        name = np.zeros(0, np.uint64)
        if len(at):
            text = text[_ranges(at, many)]
            starts = np.cumsum(many) - many
            name = kernel.finish(np.add.reduceat(kernel.finish(text), starts) + many.astype(np.uint64))
            _, once = np.unique(name, return_index=True)  # lists of the same texts
            at, many, name = starts[once], many[once], name[once]
        member = _ranges(at, many)
        long = np.repeat(many > j.most, many)
        return pa.table({"list": pa.array(np.repeat(name, many).view(np.int64), mask=long), "a": text[member].view(np.int64), "b": pa.array(text[np.repeat(at, many)].view(np.int64), mask=~long)})

    return packed.groupBy("shard").applyInArrow(run, "list long, a long, b long").distinct()


# -- step 2: who of a list may be linked ---------------------------------------------------------


def _may_link(sizes: np.ndarray, maps: np.ndarray, slack: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the bounds of a node pair allow a link."""
    ok = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
    shared = np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64)
    return ok & (shared + np.minimum(slack[a], slack[b]) >= threshold / (1 + threshold) * (sizes[a] + sizes[b]) - 1e-9)


def _list_edges(lists: DataFrame, j: Join) -> DataFrame:
    """(a, b): a forest of each list's possible links; ``lists`` has (list, a, size, map), all of a list in one partition, in order."""

    def edges(name: np.ndarray, text: np.ndarray, sizes: np.ndarray, maps: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        many = np.diff(np.concatenate([start, [len(name)]]))
        pivot = np.repeat(start, many)
        slack = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        one = np.arange(len(name))
        ok = _may_link(sizes, maps, slack, one, pivot, j.threshold) | (one == pivot)
        left, right = [one[ok & (one > pivot)]], [pivot[ok & (one > pivot)]]
        open_ = np.flatnonzero(np.add.reduceat(~ok, start) * (many > 2))
        small = open_[many[open_] <= j.few]
        member = _ranges(start[small], many[small])
        ahead = np.repeat(start[small] + many[small], many[small]) - member - 1
        x, y = np.repeat(member, ahead), _ranges(member + 1, ahead)
        step = (1 << 22) // j.bits
        for k in range(0, len(x), step):
            p, q = x[k : k + step], y[k : k + step]
            fits = _may_link(sizes, maps, slack, p, q, j.threshold)
            left.append(q[fits])
            right.append(p[fits])
        for k in open_[many[open_] > j.few].tolist():
            all_ = np.arange(start[k], start[k] + many[k])
            all_ = all_[np.argsort(sizes[all_], kind="stable")]
            rest = all_[~ok[all_]]
            x, y = (Tree.of(maps[i], sizes[i], slack[i], j.leaf, j.fanout) for i in (rest, all_))
            pairs = [(rest[p], all_[q]) for p, q in x.join(y, j.threshold)]
            if pairs:
                p, q = (np.concatenate(z) for z in zip(*pairs))
                left.append(p)
                right.append(q)
        least, other = _star(text[np.concatenate(left)], text[np.concatenate(right)])
        return pa.record_batch({"a": other, "b": least})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not len(batch):
                continue
            width = j.bits // 64
            maps = np.frombuffer(b"".join(batch.column("map").to_pylist()), np.uint64).reshape(-1, width)
            held.append((batch.column("list").to_numpy(), batch.column("a").to_numpy(), batch.column("size").to_numpy(), maps))
            name, *rest = (np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(name, name[-1]))  # the last list may go on
            if last:
                yield edges(name[:last], *(x[:last] for x in rest))
            held = [(name[last:], *(x[last:] for x in rest))]
        if held:
            yield edges(*(np.concatenate(x) for x in zip(*held)))

    return lists.select("list", "a", "size", "map").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component; edges has two integer columns a and b.

    Large-star and small-star; minima are aggregated before their shuffle, and joins on a hub's key are for AQE to split."""
    kernel.shared_checkpoints(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v", F.lit(1)).cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = seen


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, other): the nodes of the graph of edges a - b, each with the least of its component, but for these themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        new = new[new]
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, low):
            break
        low = new
    other = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[low[other]], nodes[other]


# -- the tree ------------------------------------------------------------------------------------


def _bitmaps(tokens: np.ndarray, owner: np.ndarray, count: int, bits: int) -> np.ndarray:
    """uint64 count x bits/64; tokens are slots below bits."""
    out = np.zeros((count, bits // 64), np.uint64)
    step = max(1, (1 << 25) // bits)
    edges = np.searchsorted(owner, np.arange(0, count + step, step))
    for k in range(0, count, step):
        a, b = edges[k // step], edges[k // step + 1]
        flags = np.zeros((min(step, count - k), bits), np.uint8)
        flags[owner[a:b] - k, tokens[a:b]] = 1
        out[k : k + step] = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
    return out


class Tree:
    """Levels of nodes from the documents (level 0) up; each node's children are consecutive on the level below."""

    def __init__(self, sets: list[np.ndarray], bits: int, leaf: int, fanout: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        slots = (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)
        maps = _bitmaps(slots, np.repeat(np.arange(len(sets)), sizes), len(sets), bits)
        self._build(maps, sizes, sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64), leaf, fanout)

    @classmethod
    def of(cls, maps: np.ndarray, sizes: np.ndarray, slack: np.ndarray, leaf: int, fanout: int) -> Tree:
        """Of signatures that are there already."""
        tree = cls.__new__(cls)
        tree._build(maps, sizes, slack, leaf, fanout)
        return tree

    def _build(self, maps: np.ndarray, sizes: np.ndarray, slack: np.ndarray, leaf: int, fanout: int) -> None:
        self.levels, self.step = [(maps, sizes, sizes, slack)], []
        self.seen: dict[int, int] = {}  # by level: pairs of nodes that were met, and that were not pruned
        self.kept: dict[int, int] = {}
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            step = fanout if self.step else leaf
            at = np.arange(0, len(maps), step)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))
            self.step.append(step)

    def join(self, other: Tree, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of documents that the bounds can't rule out, in slices; within one tree each pair once."""
        while len(self.levels) < len(other.levels):
            self.levels.append(self.levels[-1])
            self.step.append(1)
        while len(other.levels) < len(self.levels):
            other.levels.append(other.levels[-1])
            other.step.append(1)
        zero = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, zero, zero)]
        limit = max(256, (1 << 21) // self.levels[0][0].shape[1])
        while stack:
            level, a, b = stack.pop()
            if len(a) > limit:
                stack += [(level, a[k : k + limit], b[k : k + limit]) for k in range(0, len(a), limit)]
                continue
            (ma, la, ha, sa), (mb, lb, hb, sb) = self.levels[level], other.levels[level]
            least = np.ceil(threshold / (1 + threshold) * (la[a] + lb[b]) - 1e-9)
            ok = (ha[a] >= threshold * lb[b] - 1e-9) & (hb[b] >= threshold * la[a] - 1e-9)
            a, b, least = a[ok], b[ok], least[ok]
            shared = np.bitwise_count(ma[a] & mb[b]).sum(axis=1, dtype=np.int64)
            again = shared + np.minimum(sa[a], sb[b]) >= least
            self.seen[level], self.kept[level] = self.seen.get(level, 0) + len(ok), self.kept.get(level, 0) + int(again.sum())
            a, b = a[again], b[again]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            below = level - 1
            for (tree, side) in ((self, 0), (other, 1)):
                step, total = tree.step[below], len(tree.levels[below][0])
                first = (a if side == 0 else b) * step
                many = np.minimum(first + step, total) - first
                again = np.repeat(np.arange(len(a)), many)
                child = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many) + first[again]
                a, b = (child, b[again]) if side == 0 else (a[again], child)
            if self is other:
                ok = a < b if below == 0 else a <= b
                a, b = a[ok], b[ok]
            if len(a):
                stack.append((below, a, b))


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, j: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in left, index in right, Jaccard index) of all pairs at the threshold; right None: within left, each pair once."""
    sets = left + (right or [])
    largest = max((len(s) for s in sets), default=0)
    if not largest or right == []:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bits = 1 << int(np.clip(np.ceil(np.log2(8 * largest)), 9, 16))
    tree = Tree(left, bits, j.leaf, j.fanout)
    other = tree if right is None else Tree(right, bits, j.leaf, j.fanout)
    sizes = np.array([len(s) for s in sets], np.int64)
    # exact comparison: bitmaps over the grams that at least two of the sets have
    values, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared_by = often > 1
    rank, keep = np.cumsum(shared_by) - 1, shared_by[inverse]
    exact = _bitmaps(rank[inverse[keep]], np.repeat(np.arange(len(sets)), sizes)[keep], len(sets), (int(shared_by.sum()) // 64 + 1) * 64)
    shift, out = (0 if right is None else len(left)), ([], [], [])
    limit = max(64, (1 << 21) // exact.shape[1])
    for a_all, b_all in tree.join(other, j.threshold):
        for k in range(0, len(a_all), limit):
            a, b = a_all[k : k + limit], b_all[k : k + limit]
            shared = np.bitwise_count(exact[a] & exact[b + shift]).sum(axis=1).astype(np.int64)
            index = shared / (sizes[a] + sizes[b + shift] - shared)
            ok = index >= j.threshold
            for x, y in zip(out, (a[ok], b[ok], index[ok])):
                x.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, float)))


# -- step 3: the whole join ----------------------------------------------------------------------

_SET = "root long, block long, f1 long, f2 long, grams binary"


def _sets(docs: DataFrame, chosen: DataFrame, j: Join) -> DataFrame:
    """(root, block, f1, f2, grams): the sorted distinct grams of the texts in ``chosen`` (doc_id, root, block), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in kernel.slices(batch):
                h, bounds = _sets_of(texts, j)
                some = np.flatnonzero(np.diff(bounds))
                if len(some):
                    f1, f2 = _fingerprints(h, bounds[some])
                    ok = f1.view(np.int64) == part.column("f1").to_numpy()[some]  # another row of the doc_id may have another text
                    some, f1, f2 = some[ok], f1[ok], f2[ok]
                    grams = pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in some], pa.binary())
                    yield pa.record_batch({**{c: part.column(c).take(pa.array(some)) for c in ("root", "block")}, "f1": f1.view(np.int64), "f2": f2.view(np.int64), "grams": grams})

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").select("root", "block", "f1", "text")
    return rows.mapInArrow(run, _SET).groupBy("root", "block", "f1", "f2").agg(F.first("grams").alias("grams"))


def _found(ids: list[np.ndarray], sets: list[list[np.ndarray]], j: Join) -> pa.Table:
    """(a, b, links): how many links each text has among these (b null), and the least of its component among them (links null)."""
    a, b, _ = similar_pairs(sets[0], sets[1] if len(sets) > 1 else None, j)
    a, b = ids[0][a], ids[-1][b]
    texts, links = np.unique(np.concatenate([a, b]), return_counts=True)
    least, other = _star(a, b)
    none = [pa.nulls(len(texts), pa.int64()), pa.nulls(len(least), pa.int64())]
    return pa.table({"a": pa.chunked_array([texts, other]), "b": pa.chunked_array([none[0], pa.array(least)]), "links": pa.chunked_array([pa.array(links), none[1]])})


def _of(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Texts by size, then by their least hash, which like ones have in common."""
    ids, sets = rows.column("f1").to_numpy(), [np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()]
    spot = [int(kernel.finish(g * np.uint64(0x9FB21C651E98DF25)).min()) for g in sets]
    order = sorted(range(len(sets)), key=lambda i: (spot[i], len(sets[i]), ids[i]))
    return ids[order], [sets[i] for i in order]


_LINKS = "a long, b long, links long"


def _texts(docs: DataFrame, j: Join) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, f1, f2, text_id, n_copies) of all rows with grams; (f1, n_links) of linked texts; (a, b) edges that connect them; (doc_id) of the other rows."""
    spark = docs.sparkSession
    kernel.shared_checkpoints(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/jaccard-{uuid.uuid4().hex}"
    n, shards = docs.count(), 8
    while shards * j.shard < n * j.bands:
        shards *= 2
    _scan(docs, shards, j).write.parquet(f"{base}/scan")
    scan = spark.read.schema(_SCAN).parquet(f"{base}/scan")
    rows, bare = scan.where("size > 0"), scan.where("size = 0").select("doc_id")
    by = rows.groupBy("f1", "f2").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n"))
    by.write.parquet(f"{base}/texts")
    texts = spark.read.schema("f1 long, f2 long, text_id long, n long").parquet(f"{base}/texts")
    _lists(scan.where("shard is not null").select("shard", "keys", "texts", "sizes"), j).write.parquet(f"{base}/lists")
    lists = spark.read.schema("list long, a long, b long").parquet(f"{base}/lists")
    short = lists.where("list is not null").select("list", "a")
    one = short.select(F.col("a").alias("f1")).distinct().join(texts, "f1").select("f1", "f2", F.col("text_id").alias("doc_id"))
    maps = rows.join(one, ["f1", "f2", "doc_id"], "left_semi").select(F.col("f1").alias("a"), "size", "map").dropDuplicates(["a"])
    short = short.join(maps, "a").repartition("list").sortWithinPartitions("list", "a")
    possible = _list_edges(short, j).union(lists.where("list is null").select("a", "b"))
    roots = components(possible).checkpoint()
    blocks = roots.groupBy("root").agg(F.ceil(F.count("*") / j.block).alias("blocks"))
    chosen = texts.join(roots.join(blocks, "root").withColumnRenamed("node", "f1"), "f1").select(F.col("text_id").alias("doc_id"), "root", F.expr("pmod(xxhash64(f1, f2), blocks)").alias("block"), "f1")
    _sets(docs, chosen, j).write.parquet(f"{base}/sets")
    sets = spark.read.schema(_SET).parquet(f"{base}/sets")

    def within(rows: pa.Table) -> pa.Table:
        ids, grams = _of(rows)
        return _found([ids], [grams], j)

    found = sets.groupBy("root", "block").applyInArrow(within, _LINKS)
    if not blocks.where("blocks > 1").isEmpty():
        found = found.union(_across(sets.join(blocks.where("blocks > 1").select("root"), "root", "left_semi"), j))
    found = found.checkpoint()
    for done in ("lists", "sets"):
        kernel.remove(spark, f"{base}/{done}")
    links = found.where("b is null").groupBy(F.col("a").alias("f1")).agg(F.sum("links").alias("n_links"))
    named = rows.select("doc_id", "f1", "f2").join(texts, ["f1", "f2"]).select("doc_id", "f1", "f2", "text_id", (F.col("n") - 1).alias("n_copies"))
    return named, links, found.where("b is not null").select("a", "b"), bare


def _across(sets: DataFrame, j: Join) -> DataFrame:
    """What is found between texts of different blocks: the upper levels of the components' trees."""
    bits = 1 << 16

    def node(rows: pa.Table) -> pa.Table:
        _, grams = _of(rows)
        tree = Tree(grams, bits, len(grams), 2)
        maps, low, high, slack = tree.levels[-1]
        return pa.table({"root": rows.column("root")[:1], "block": rows.column("block")[:1], "map": pa.array([maps[0].tobytes()], pa.binary()), "low": low, "high": high, "slack": slack})

    nodes = sets.groupBy("root", "block").applyInArrow(node, "root long, block long, map binary, low long, high long, slack long").checkpoint()
    two = nodes.alias("x").join(nodes.alias("y"), (F.col("x.root") == F.col("y.root")) & (F.col("x.block") < F.col("y.block")) & (F.col("x.high") >= j.threshold * F.col("y.low")) & (F.col("y.high") >= j.threshold * F.col("x.low")))
    two = two.select(F.col("x.root"), F.col("x.block").alias("one"), F.col("y.block").alias("two"), F.col("x.map").alias("m1"), F.col("y.map").alias("m2"), F.least("x.slack", "y.slack").alias("slack"), F.ceil(j.threshold / (1 + j.threshold) * (F.col("x.low") + F.col("y.low")) - 1e-9).alias("least"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [int(np.bitwise_count(np.frombuffer(p, np.uint64) & np.frombuffer(q, np.uint64)).sum()) for p, q in zip(batch.column("m1").to_pylist(), batch.column("m2").to_pylist())]
            ok = np.array(shared, np.int64) + batch.column("slack").to_numpy() >= batch.column("least").to_numpy()
            yield batch.select(["root", "one", "two"]).filter(pa.array(ok, pa.bool_()))

    left = two.mapInArrow(prune, "root long, one long, two long")
    sent = left.select("root", "one", "two", F.explode(F.array("one", "two")).alias("block")).join(sets, ["root", "block"])

    def cross(rows: pa.Table) -> pa.Table:
        one = rows.column("one")[0].as_py()
        is_one = np.equal(rows.column("block").to_numpy(), one)
        (i1, g1), (i2, g2) = _of(rows.filter(pa.array(is_one))), _of(rows.filter(pa.array(~is_one)))
        return _found([i1, i2], [g1, g2], j)

    return sent.select("root", "one", "two", "block", "f1", "grams").groupBy("root", "one", "two").applyInArrow(cross, _LINKS)


def join(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """(doc_id, class_id, text_id, n_copies, n_links) of every row with a doc_id."""
    named, links, edges, bare = _texts(docs, j)
    roots = components(edges).withColumnRenamed("node", "f1")
    texts = named.select("f1", "text_id").distinct().join(roots, "f1", "left").withColumn("root", F.coalesce("root", "f1"))
    least = texts.groupBy("root").agg(F.min("text_id").alias("class_id"))
    of = texts.select("f1", "root").distinct().join(least, "root").join(links, "f1", "left").select("f1", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    zero = F.lit(0).cast("long")
    return named.join(of, "f1").select("doc_id", "class_id", "text_id", "n_copies", "n_links").union(bare.select("doc_id", "doc_id", "doc_id", zero, zero))


def keep_one(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """The rows of ``docs`` without all but the smallest doc_id of each class, and without repeats of a doc_id (one of them stays); rows of null doc_id stay."""
    gone = join(docs, j).where("doc_id <> class_id").select("doc_id").distinct()
    numbered = docs.where("doc_id is not null")
    return numbered.join(gone, "doc_id", "left_anti").select(docs.columns).dropDuplicates(["doc_id"]).union(docs.where("doc_id is null"))
