"""Jaccard join, decontamination, SentencePiece, token counts, and the pipeline, against brute force or the library."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import sentencepiece

from tessella.llm import decontaminate as D
from tessella.llm import pieces as P
from tessella.llm import signature_tree as S
from tessella.llm import transducer as T

from .conftest import words


# -- Jaccard join --------------------------------------------------------------------------------


def grams(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def links(rows, threshold=S.Join().threshold):
    """Links between different sets of grams."""
    sets = {frozenset(g) for doc_id, text in rows if doc_id is not None and (g := grams(text))}
    return {(x, y) for x, y in combinations(sets, 2) if len(x & y) / len(x | y) >= threshold}


def plain_join(rows, threshold=S.Join().threshold):
    """The rows of the join, sorted, by brute force."""
    pairs = links(rows, threshold)
    sets = [(doc_id, frozenset(grams(text))) for doc_id, text in rows if doc_id is not None]
    ids, copies, many, root = {}, Counter(s for _, s in sets), Counter(x for p in pairs for x in p), {}
    for doc_id, s in sets:
        ids[s] = min(doc_id, ids.get(s, doc_id))

    def top(x):
        while root.get(x, x) is not x:
            x = root[x]
        return x

    for x, y in pairs:
        if (x := top(x)) is not (y := top(y)):
            root[y] = x
    least = {}
    for s in ids:
        least[top(s)] = min(ids[s], least.get(top(s), ids[s]))
    return sorted((d, least[top(s)], ids[s], copies[s] - 1, many[s]) if s else (d, d, d, 0, 0) for d, s in sets)


def joined(docs, j=S.Join()):
    return sorted((r["doc_id"], r["class_id"], r["text_id"], r["n_copies"], r["n_links"]) for r in S.join(docs, j).collect())


def near_copies(seed, groups=12, most=30):
    rng, rows, doc_id = random.Random(seed), [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, most)):
            copy = [w if rng.random() > 0.03 else f"w{rng.randrange(400)}" for w in base]
            rows.append((doc_id, " ".join(copy)))
            doc_id += 1
    return rows


@pytest.mark.parametrize("block, most, few", [(2048, 1024, 24), (7, 1024, 3), (2048, 3, 3)])
def test_join_equals_brute_force(spark, block, most, few):
    rows = near_copies(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    j = S.Join(block=block, most=most, few=few, leaf=3, fanout=2, shard=100, flush=2000)
    want = plain_join(rows)
    assert joined(docs, j) == want and sum(r[4] for r in want) > 500
    assert {r["doc_id"] for r in S.keep_one(docs, j).collect()} == {r[0] for r in want if r[0] == r[1]}


def test_join_of_real_documents(documents):
    assert joined(documents) == plain_join([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_join_loses_no_link_at_the_threshold(spark):
    """Pairs that share just enough, in every place, among texts that all share a passage."""
    rng, rows = random.Random(8), []
    passage = " ".join(f"p{k}" for k in range(30))
    for k in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 120))]
        cut = rng.randint(0, len(base) * 9 // 10)
        rows += [(2 * k, " ".join(base) + " " + passage), (2 * k + 1, " ".join(base[: len(base) - cut]) + " " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_join(rows)
    assert joined(docs, S.Join(flush=3000)) == want and 30 < sum(r[4] == 1 for r in want) < 270


def test_tree_prunes_but_loses_nothing():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.95)], rng.integers(0, 1 << 63, 3, dtype=np.uint64)])) for s in sets[:40]]
    j = S.Join(leaf=4, fanout=3)
    a, b, v = S.similar_pairs(sets, None, j)
    got = {tuple(sorted(x)): y for x, y in zip(zip(a.tolist(), b.tolist()), v.tolist())}
    want = {}
    for i, k in combinations(range(len(sets)), 2):
        n = len(np.intersect1d(sets[i], sets[k]))
        if (value := n / (len(sets[i]) + len(sets[k]) - n)) >= j.threshold:
            want[i, k] = value
    assert got == pytest.approx(want) and want
    tree = S.Tree(sets, 1 << 10, 4, 3)
    candidates = sum(len(x) for x, _ in tree.join(tree, 0.7))
    assert candidates < len(sets) ** 2 / 8


def test_inner_nodes_prune(spark):
    """Of the pairs of inner nodes that the traversal meets over 2,048 documents of sf0.1, less than half are kept."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 2048").collect()]
    h, bounds = S._sets_of(texts, S.Join())
    sets = [h[a:b] for a, b in zip(bounds[:-1], bounds[1:]) if b > a]
    sets.sort(key=len)
    tree = S.Tree(sets, 1 << 14, S.Join().leaf, S.Join().fanout)
    assert sum(len(x) for x, _ in tree.join(tree, S.Join().threshold)) < len(sets) ** 2 / 200
    inner = [k for k in tree.seen if k]
    assert sum(tree.kept[k] for k in inner) < sum(tree.seen[k] for k in inner) / 2


def test_join_odd_rows(spark, odd, empty):
    assert joined(odd) == plain_join([(r["doc_id"], r["text"]) for r in odd.collect()])
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert S.join(empty).collect() == [] and S.keep_one(empty).collect() == []
    clash = odd.selectExpr("*", "1 as class_id", "2 as text_id", "3 as f1", "4 as block", "5 as size", "6 as map", "7 as gram", "8 as list", "9 as a")
    assert joined(clash) == joined(odd) and S.keep_one(clash).columns == clash.columns
    same = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "other words are in this row"), (3, "Other words are in this row!")]
    assert joined(spark.createDataFrame(same, "doc_id long, text string")) == plain_join(same)


# -- decontamination -----------------------------------------------------------------------------


@pytest.mark.parametrize("n, sigma", [(1, 2), (2, 3), (60, 3), (500, 5), (2000, 300)])
def test_suffix_array_and_index(n, sigma):
    rng = np.random.default_rng(n)
    text = rng.integers(1, sigma + 1, n)
    ended = [*text.tolist(), 0]
    assert D.suffix_array(np.array(ended), sigma + 1).tolist() == sorted(range(n + 1), key=lambda i: ended[i:])
    index = D.FMIndex(text, sigma + 1, 4)
    for length in (1, 2, 3):
        phrase = text[: min(length, n)]
        lo, hi = index.search(phrase[None, :], np.array([len(phrase)]))
        want = [i for i in range(n) if ended[i : i + len(phrase)] == phrase.tolist()]
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_suffix_array_of_long_repeats():
    text = [3] * 4000 + [2, 1] + [3] * 4000 + [0]
    order = D.suffix_array(np.array(text), 4)
    assert sorted(order.tolist()) == list(range(len(text))) and all(text[a:] < text[b:] for a, b in zip(order[::97], order[97::97]))


def plain_spans(rows, bench, n=8):
    phrases = defaultdict(set)
    for item, text in bench:
        w = words(text)
        if m := min(n, len(w)):
            for k in range(len(w) - m + 1):
                phrases[tuple(w[k : k + m])].add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for doc_id, text in rows:
        at = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text or "")]
        w, found, items = words(text), [], set()
        hits = sorted((k, k + m) for m in sizes for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in phrases)
        for a, b in hits:
            items |= phrases[tuple(w[a:b])]
            if found and a <= found[-1][1]:
                found[-1][1] = max(found[-1][1], b)
            else:
                found.append([a, b])
        if found:
            out.append((doc_id, [(at[a][0], at[b - 1][1]) for a, b in found], sorted(items)))
    return out


def test_spans_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    rows, items = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()]
    for s in (D.Search(), D.Search(shard_words=3000, sample=3, chunk=100)):
        got = [(r["doc_id"], [(x["start"], x["end"]) for x in r["spans"]], r["item_ids"]) for r in D.spans(docs, bench, s).orderBy("doc_id").collect()]
        assert got == plain_spans(rows, items) and len(got) > 20
    for r in D.clean(docs, bench).collect():
        assert not plain_spans([(0, r["text"])], items) and r["n_chars"] == len(r["text"])


def test_decontamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "quick BROWN fox, jumps over the lazy"), (1, "quick BROWN fox, jumps over the lazy"), (2, None), (3, "the lazy dog"), (5, "QUICK brown"), (None, "lorem ipsum dolor sit amet lorem ipsum dolor sit"), (4, "")], "item_id long, text string")
    got = D.spans(odd, bench).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 5]
    assert {r["clean_text"] for r in got if r["doc_id"] == 1} == {"the "} and {tuple(r["item_ids"]) for r in got if r["doc_id"] == 1} == {(1, 3, 5)} and [r for r in got if r["doc_id"] == 5][0]["n_removed"] > 100_000
    cleaned = D.clean(odd, bench)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count()
    left = D.clean(odd, spark.createDataFrame([(1, "one")], "item_id long, text string"))
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 1, 2, 3, 4, 5, 6, 7, 9, 10]  # of document 8 no word is left
    assert D.spans(empty, bench).collect() == [] and D.spans(odd, bench.limit(0)).collect() == []


# -- SentencePiece and token counts --------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load()


def hard_texts():
    rng = random.Random(3)
    alphabet = "abcdefghijklmnop  \n.,ÉéßñaaaeeettthhTHE012#日本"
    out = ["", " ", "  ", "a", "\n", "\n\n x", "é😀z  \t 日本語テスト 한국어 كتاب", "a" * 3000, "ab" * 700, "   lead", " tail  ", "日本" * 300, "x   y", "\x00\x01"]
    out += [" " * n for n in (14, 15, 16, 17, 31, 32, 33, 200)] + [" " * n + "the" for n in (1, 2, 15, 16, 17)] + [" " * n + "1" for n in (1, 2, 15, 16, 17)]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(400)]


def test_ids_are_the_librarys(library, vocabulary):
    texts = hard_texts()
    encoder = P.Encoder(vocabulary)
    ids, bounds = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == library.encode(texts)
    assert encoder.decode(ids, bounds) == texts


def test_unigram_lattice_takes_the_best_path():
    letters = "ab"
    pieces = ["<unk>", "▁", *letters, "ab", "ba", "▁a", "aba", "▁ab"]
    rng = random.Random(1)
    v = P.Vocabulary(pieces, [rng.uniform(-9, -1) for _ in pieces], [i > 0 for i in range(len(pieces))], [0] * 256, bpe=False)

    def best(word):
        if not word:
            return 0.0
        return max((v.scores[v.ids[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in v.ids))

    texts = sorted({"▁" + "".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(60)})
    for word, ids in zip(texts, P.forward(texts, v)):
        assert "".join(pieces[i] for i in ids) == word and sum(v.scores[i] for i in ids) == pytest.approx(best(word))


def test_counts_are_the_librarys(library, vocabulary, monkeypatch):
    texts = hard_texts()
    for chunk in (256, 3):
        monkeypatch.setattr(T, "CHUNK", chunk)
        assert T.Machine(vocabulary).count(texts).tolist() == [len(x) for x in library.encode(texts)]


@pytest.mark.parametrize("chunk", [256, 7])
def test_text_without_spaces_takes_few_rounds(library, vocabulary, monkeypatch, chunk):
    """Chunk maps are tabulated in as many rounds as there are states to reach, not as there are chunks."""
    monkeypatch.setattr(T, "CHUNK", chunk)
    rng = random.Random(2)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(9000)), "a" * 9001, "abc" * 3000, "x " + "日本" * 900 + "q" * 5000, "no", "ab" * 4000 + " " + "ba" * 3000]
    machine, rounds = T.Machine(vocabulary), []
    walk = machine._walk
    monkeypatch.setattr(machine, "_walk", lambda *x: (rounds.append(1), walk(*x))[1])
    assert machine.count(texts).tolist() == [len(x) for x in library.encode(texts)]
    assert len(rounds) < 60


def test_machine_starts_anew_when_it_is_full(library, vocabulary, monkeypatch):
    monkeypatch.setattr(T, "TABLE_CELLS", 1000)
    m, texts = T.Machine(vocabulary), hard_texts()
    for k in range(0, len(texts), 100):
        assert m.count(texts[k : k + 100]).tolist() == [len(x) for x in library.encode(texts[k : k + 100])]


def test_encode_decode_and_count_documents(documents, library):
    encoded = P.encode(documents)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in encoded.collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["lossless"]
    assert {r["doc_id"]: r["text"] for r in P.decode(encoded).collect()} == texts
    counts = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(documents).collect()}
    assert counts == {i: len(library.encode(t)) for i, t in texts.items()}


def test_tokenizers_odd_rows(odd, empty, library):
    encoded = {(r["doc_id"], r["n_tokens"], r["lossless"]) for r in P.encode(odd).collect()}
    for doc_id, text in [(r["doc_id"], r["text"]) for r in odd.collect()]:
        assert (doc_id, len(library.encode(text or "")), "▁" not in (text or "")) in encoded
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in T.token_counts(odd).collect()) == sorted((r["doc_id"] or 0, len(library.encode(r["text"] or ""))) for r in odd.collect())
    assert P.encode(empty).collect() == [] and T.token_counts(empty).collect() == []


# -- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages_and_run(spark, library):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, now = [docs.count()], docs
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, now, sf).cache()
        assert after.columns == docs.columns, name
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        texts = {r["doc_id"]: r["text"] for r in after.collect()}
        assert texts.keys() <= before.keys()
        if name == "ngram_jaccard_join":
            assert texts.keys() == {r[0] for r in plain_join(before.items()) if r[0] == r[1]}
        if name == "benchmark_decontamination":
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            spans = {i: x for i, x, _ in plain_spans(before.items(), bench)}
            assert all(texts[i] == D.cut(before[i], spans.get(i, [])) for i in texts) and all(i in spans for i in before.keys() - texts.keys())
        else:
            assert all(before[i] == t for i, t in texts.items())
        sizes.append(len(texts))
        now = after
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] >= sizes[4] > sizes[0] / 2
    final = {r["doc_id"]: r["ids"] for r in C.run(spark, sf).collect()}
    assert final == {r["doc_id"]: library.encode(r["text"]) for r in now.collect()}


def test_pipeline_survives_odd_and_empty_tables(spark, odd, empty, library, tmp_path):
    import corpus_pipeline as C

    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (7, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text")
    bench = spark.createDataFrame([(1, "lorem ipsum dolor"), (2, None), (3, "")], "item_id long, text string").selectExpr("*", "1 as doc_id")
    clash = odd.selectExpr("*", "1 as f1", "2 as class_id", "3 as n_tokens", "5 as language", "6 as spans")
    for name, rows in (("odd", clash), ("empty", empty)):
        home = tmp_path / name
        rows.write.parquet(f"{home}/documents.parquet")
        (labels if name == "odd" else labels.limit(0)).write.parquet(f"{home}/labels.parquet")
        (bench if name == "odd" else bench.limit(0)).write.parquet(f"{home}/benchmark.parquet")
    out = {r["doc_id"]: r for r in C.run(spark, str(tmp_path / "odd")).collect()}
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert set(out) <= {None, 1, 5, 7, 8, 9, 10} and {None, 1, 7} <= set(out)  # without words: 2, 3, 4, 6
    assert all(r["ids"] == library.encode(texts[i]) for i, r in out.items() if i != 5)
    if 5 in out:
        assert out[5]["n_tokens"] < len(library.encode(texts[5])) / 2  # the passage of the benchmark is gone from it
    assert C.run(spark, str(tmp_path / "empty")).collect() == []


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    from tessella.llm import kernel

    def session(master, folder):
        used = []
        return Fake(conf=Fake(get=lambda key, default=None: folder), sparkContext=Fake(master=master, getCheckpointDir=lambda: None, setCheckpointDir=used.append)), used

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        kernel.shared_checkpoints(session("spark://host:7077", None)[0])
    for master, folder in (("spark://host:7077", "hdfs://x/y"), ("local[4]", None), ("local", "/x")):
        fake, used = session(master, folder)
        kernel.shared_checkpoints(fake)
        assert len(used) == 1 and (folder is None or used == [folder])
