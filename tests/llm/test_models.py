"""HMM scores, quality rules, language identification."""

import math
import random

import numpy as np
import pytest

from tessella.llm import hmm, kernel, langid, quality

from .conftest import words


# -- HMM -----------------------------------------------------------------------------------------


def brute(model, seq):
    """Log-likelihood and expected counts by the unscaled recursions."""
    if not len(seq):
        return 0.0, None
    a = [model.initial * model.emission[seq[0]]]
    for o in seq[1:]:
        a.append((a[-1] @ model.transition) * model.emission[o])
    b = [np.ones(len(model.initial))]
    for o in seq[:0:-1]:
        b.insert(0, model.transition @ (model.emission[o] * b[0]))
    total = a[-1].sum()
    gamma = np.array(a) * np.array(b) / total
    xi = sum(((a[t][:, None] * model.transition * (model.emission[seq[t + 1]] * b[t + 1])) / total for t in range(len(seq) - 1)), np.zeros_like(model.transition))
    return math.log(total), (gamma, xi)


@pytest.mark.parametrize("segment", [1, 2, 5, 100])
def test_recursions_equal_brute_force(segment):
    s = hmm.Settings(states=3, bits=4, segment=segment)
    model, rng = hmm.Model.start(s), np.random.default_rng(1)
    lengths = [0, 1, 2, 5, 6, 10, 11, 0, 23, 3]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    symbols = rng.integers(0, 16, bounds[-1])
    want = hmm.Counts.none(s)
    likelihoods = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        value, counts = brute(model, symbols[lo:hi])
        likelihoods.append(value)
        if counts:
            want.initial += counts[0][0]
            want.transition += counts[1]
            np.add.at(want.emission, symbols[lo:hi], counts[0])
    got = hmm.Counts.none(s)
    assert np.allclose(hmm.Recursion(model, symbols, bounds, segment).likelihood(len(lengths)), likelihoods)
    assert math.isclose(hmm.Recursion(model, symbols, bounds, segment).expect(got), sum(likelihoods))
    for name in ("initial", "transition", "emission"):
        assert np.allclose(getattr(got, name), getattr(want, name))


def test_training_raises_the_likelihood_and_scores_are_exact(spark, documents):
    s = hmm.Settings(bits=10, rounds=2)
    totals = [hmm.score(documents, hmm.Settings(bits=10, rounds=r)).agg({"log_likelihood": "sum"}).first()[0] for r in (0, 1, 3)]
    assert totals[0] < totals[1] < totals[2]
    model = hmm.train(documents, s)
    scored = {r["doc_id"]: r for r in hmm.score(documents, s).collect()}
    assert len(scored) == documents.count()
    for r in documents.where("length(text) < 300").limit(5).collect():  # unscaled sums would underflow on longer ones
        symbols, _ = hmm.symbols_of([r["text"]], s)
        assert scored[r["doc_id"]]["n_tokens"] == len(words(r["text"]))
        assert math.isclose(scored[r["doc_id"]]["log_likelihood"], brute(model, symbols)[0], rel_tol=1e-9)


def test_training_ends_when_it_gains_little(documents, monkeypatch):
    ran = []
    count = hmm.counts
    monkeypatch.setattr(hmm, "counts", lambda *x: (ran.append(1), count(*x))[1])
    hmm.train(documents, hmm.Settings(rounds=4, tolerance=1.0))
    assert len(ran) == 2  # the second round tells what the first gained
    hmm.train(documents, hmm.Settings(rounds=3, tolerance=0.0))
    assert len(ran) == 5


def test_hmm_odd_rows(odd, empty):
    rows = hmm.score(odd, hmm.Settings(bits=8, rounds=1)).collect()
    assert len(rows) == 12
    none = [r for r in rows if r["n_tokens"] == 0]
    assert {r["doc_id"] for r in none} == {2, 3, 4, 6} and all(r["log_likelihood"] == 0 and r["mean_log_likelihood"] is None for r in none)
    twice = [r for r in rows if r["doc_id"] == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert hmm.score(empty, hmm.Settings(bits=8, rounds=1)).collect() == []


def test_every_distinct_word_has_its_own_row_and_unknown_words_share_one(spark, documents):
    s = hmm.Settings(bits=2, rounds=1)
    known = {w for r in documents.select("text").collect() for w in words(r["text"])}
    model = hmm.train(documents, s)
    assert len(np.asarray(model.emission)) == len(known) + 1
    rows = spark.createDataFrame([(1, "often " * 200 + "seldom"), (2, "and and other")], "doc_id long, text string")
    model = hmm.train(rows, s)
    often, seldom, never, none = (model.emission[hmm.symbols_of([w], s)[0][0]] for w in ("often", "seldom", "never", "nowhere"))
    assert (often > 10 * seldom).all() and (seldom > never).all() and (never == none).all()
    assert np.allclose(np.asarray(model.emission).sum(axis=0), 1)


def test_counts_do_not_depend_on_partitions(documents):
    s = hmm.Settings(bits=8, rounds=1)
    one, many = (hmm.train(documents.repartition(n), s) for n in (1, 7))
    assert np.allclose(one.emission, many.emission, atol=1e-7) and np.allclose(one.transition, many.transition, atol=1e-6)


# -- quality rules -------------------------------------------------------------------------------


def plain_scores(rows, trusted, rules):
    """The score of each row, from plain dictionaries over (bucket) counts."""
    size = 1 << rules.bits

    def buckets(text):
        ids, _ = quality._buckets([text or ""], rules)
        return ids.tolist()

    raw, target = [0] * size, [0] * size
    for doc_id, text in rows:
        for b in buckets(text):
            raw[b] += 1
            target[b] += doc_id in trusted
    if not any(target):
        return [(len(buckets(t)), 0.0) for _, t in rows]
    out = []
    for _, text in rows:
        ids = buckets(text)
        total = 0.0
        for b in ids:
            p = (raw[b] + 1) / (sum(raw) + size)
            total += math.log((target[b] + rules.prior * size * p) / (sum(target) + rules.prior * size)) - math.log(p)
        out.append((len(ids), total / (len(ids) + rules.prior_length) if ids else None))
    return out


def test_quality_equals_plain_counts(spark, documents):
    rules = quality.Rules(bits=10)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in documents.where("n_chars < 900").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    got = {r["doc_id"]: r for r in quality.score(docs, labels, rules).collect()}
    for (doc_id, _), (grams, value) in zip(rows, plain_scores(rows, trusted, rules)):
        assert got[doc_id]["n_grams"] == grams and math.isclose(got[doc_id]["score"], value, abs_tol=1e-9)
        assert got[doc_id]["keep"] == (value >= rules.threshold and not got[doc_id]["toxic_word"])
    kept = {r["doc_id"] for r in quality.accept(docs, labels, rules).collect()}
    assert kept == {i for i, r in got.items() if r["keep"]}


def test_ngrams_are_those_of_each_text():
    texts = ["a b c d", "", "x", "p q", "a b c"]
    w = kernel.Words(texts)
    h, bounds = kernel.ngrams(w, 3)
    assert np.diff(bounds).tolist() == [2, 0, 0, 0, 1] and h[0] == h[2] != h[1]
    h, bounds = kernel.ngrams(w, 3, short=True)
    assert np.diff(bounds).tolist() == [2, 0, 1, 1, 1] and len(set(h.tolist())) == 4


def test_quality_both_ways_of_marking_agree(spark, documents, monkeypatch):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a = sorted(map(tuple, quality.score(documents, labels).collect()))
    monkeypatch.setattr(quality, "ID_ARRAY_LIMIT", 3)
    assert sorted(map(tuple, quality.score(documents, labels).collect())) == a


def test_quality_rejects_junk_and_keeps_the_good(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality.score(docs, labels).join(labels, "doc_id").groupBy("quality", "toxic").agg({"keep": "count", "doc_id": "count"})
    kept = quality.score(docs, labels).where("keep").join(labels, "doc_id").groupBy("quality", "toxic").count()
    share = {(r["quality"], r["toxic"]): r["count"] for r in kept.collect()}
    total = {(r["quality"], r["toxic"]): r["count(doc_id)"] for r in out.collect()}
    assert share[1, 0] / total[1, 0] > 0.995 and share.get((0, 0), 0) / total[0, 0] < 0.05
    assert share.get((1, 1), 0) / total[1, 1] < 0.05 and share.get((0, 1), 0) / total[0, 1] < 0.05


def test_toxic_documents_do_not_pass_the_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    count = lambda rows: {(r["quality"], r["toxic"]): r["count"] for r in rows.select("doc_id").join(labels, "doc_id").groupBy("quality", "toxic").count().collect()}
    total, kept = count(docs), count(corpus_pipeline.quality_rules(spark, docs, d))
    assert kept.get((1, 1), 0) / total[1, 1] < 0.05 and kept.get((0, 1), 0) / total[0, 1] < 0.05 and kept[1, 0] / total[1, 0] > 0.99


def test_toxic_words_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (7, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert quality.accept(odd, labels, toxicity=quality.Toxicity()).columns == odd.columns
    assert quality.accept(empty, labels, toxicity=quality.Toxicity()).collect() == []


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (5, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.score(odd, labels).collect()
    assert len(rows) == 12 and {r["doc_id"] for r in rows if r["score"] is None} == {2, 3, 4}
    assert all(not r["keep"] for r in rows if r["score"] is None)
    assert quality.accept(odd, labels).columns == odd.columns
    assert quality.score(empty, labels).collect() == []
    none = labels.limit(0)
    assert all(r["keep"] == (r["n_grams"] > 0) for r in quality.score(odd, none).collect())


# -- language identification ---------------------------------------------------------------------


def test_kernel_values_equal_set_intersections():
    random.seed(2)
    texts = ["".join(random.choice("abcde ") for _ in range(random.randint(1, 60))) for _ in range(30)]
    s = langid.Settings(landmarks=6)
    model = langid.fit(texts, ["aa", "bb"] * 15, s)
    chosen = [t for lang in ("aa", "bb") for t in [x for x, y in zip(texts, ["aa", "bb"] * 15) if y == lang][:6]]

    def grams(t):
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    known = set().union(*map(grams, chosen))
    values = model.kernel_values(texts)
    for i, t in enumerate(texts):
        for k, m in enumerate(chosen):
            x = grams(t) & known
            want = len(x & grams(m)) / math.sqrt(max(1, len(x)) * len(grams(m)))
            assert math.isclose(values[i, k], want, abs_tol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    s = langid.Settings()
    seen = langid.sample(docs, s).select("doc_id")
    rest = langid.identify(docs, s).join(docs.select("doc_id", "lang"), "doc_id").join(seen, "doc_id", "left_anti")
    right, n, kept = rest.selectExpr("count_if(language = lang)", "count(*)", "count_if(keep)").first()
    assert right / n > 0.98 and kept / n > 0.99


def test_rejects_what_is_surely_of_another_language(spark, documents):
    wrong = documents.where("n_chars > 500 and lang <> 'en'").selectExpr("doc_id", "text", "'en' as lang", "source", "n_chars")
    rows = documents.union(wrong.selectExpr("doc_id + 10000", "text", "lang", "source", "n_chars"))
    gone = {r["doc_id"] for r in langid.identify(rows).where("not keep").collect()}
    planted = {r["doc_id"] + 10000 for r in wrong.collect()}
    assert len(gone & planted) > 0.8 * len(planted) and len(gone - planted) <= 2


def test_every_labelled_language_and_every_script_takes_part(spark):
    """70 languages, most in a script of their own, in one model; texts of letters that the landmarks lack are no language's."""
    rng = random.Random(5)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(30)] if k % 2 else [chr(0x61 + (k // 2 + i) % 26) for i in range(5)] + [chr(0x400 + k)]
        rows += [(100 * k + i, "".join(rng.choice([*letters, " "]) for _ in range(150)), f"x{k:02}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, langid.Settings(sample=8, landmarks=4))
    assert len(model.languages) == 70
    out = langid.identify(docs, langid.Settings(sample=8, landmarks=4)).join(docs, "doc_id").selectExpr("avg(int(language = lang))").first()[0]
    assert out > 0.95


def test_the_sample_is_bounded_under_repeats_and_long_texts(spark):
    rows = [(1, "der die das und nicht", "de")] * 300 + [(2, "y" * 900, "de"), (3, "kurz und gut", "de"), (4, "long " * 500, "en")] + [(10 + k, "the and of", "fr") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    s = langid.Settings(sample=4, longest=100, characters=35)
    got = {lang: sorted(r["doc_id"] for r in langid.sample(docs, s).collect() if r["lang"] == lang) for lang in ("de", "en", "fr")}
    assert got["de"] == [1, 3] and got["en"] == [4] and len(got["fr"]) == 3
    seen = []
    fit = langid.fit
    try:
        langid.fit = lambda texts, labels, s: (seen.append((len(texts), sum(map(len, texts)))), fit(texts, labels, s))[1]
        langid.train(docs, langid.Settings())
    finally:
        langid.fit = fit
    assert seen[0][0] == 3 + 1 + 9


def plain_decisions(rows, s):
    """(language, margin) of each text from sets, dense kernel matrices and the normal equations of the ridge, as the docstring says."""
    def grams(t):
        t = "".join(chr(c) for c in langid._letters()[np.frombuffer(t.encode("utf-32-le"), np.uint32)])
        return {t[i : i + n] for n in range(1, s.orders + 1) for i in range(len(t) - n + 1)}

    langs = sorted({lang for _, lang in rows})
    marks = [grams(t) for lang in langs for t in [x for x, y in rows if y == lang][: s.landmarks]]
    known = set().union(*marks)
    k = lambda t: np.array([len(t & m) / math.sqrt(max(1, len(t)) * len(m)) for m in marks])
    values, vectors = np.linalg.eigh(np.array([k(m) for m in marks]))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.array([k(grams(t) & known) for t, _ in rows]) @ root
    scores = []
    for lang in langs:  # one ridge a language, rows weighted so that languages weigh the same
        y = np.array([1.0 if x == lang else -1.0 for _, x in rows])
        w = np.array([1 / sum(x == z for _, z in rows) for _, x in rows])
        half = np.sqrt(w)[:, None] * phi
        scores.append(phi @ np.linalg.lstsq(np.vstack([half, math.sqrt(s.ridge) * np.eye(phi.shape[1])]), np.concatenate([np.sqrt(w) * y, np.zeros(phi.shape[1])]), rcond=None)[0])
    scores = np.array(scores).T
    top = np.sort(scores, axis=1)
    return [(langs[i], b - a) for i, a, b in zip(scores.argmax(axis=1), top[:, -2], top[:, -1])]


def test_decisions_equal_dense_matrices(spark, documents):
    s = langid.Settings(landmarks=5)
    rows = [(r["doc_id"], r["text"][:4000], r["lang"]) for r in documents.where("n_chars > 20").orderBy("doc_id").limit(80).collect()]
    want = plain_decisions([(t, lang) for _, t, lang in rows], s)
    model = langid.fit([t for _, t, _ in rows], [lang for _, _, lang in rows], s)
    best, _, lead = model.decide([t for _, t, _ in rows])
    assert [model.languages[i] for i in best] == [lang for lang, _ in want] and np.allclose(lead, [m for _, m in want], atol=2e-3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in langid.identify(docs, s).join(docs, "doc_id").collect():
        assert r["keep"] == (r["language"] == r["lang"] or r["margin"] < s.sure)


def test_language_odd_rows(odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == 12
    for r in rows:
        assert (r["language"] == "und") == (r["doc_id"] in (2, 3, 4, 6)) and (r["keep"] or r["language"] == "und" or r["margin"] >= 0.5)
    assert langid.accept(odd).columns == odd.columns
    assert langid.identify(empty).collect() == []
    unlabelled = odd.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["language"] for r in langid.identify(unlabelled).collect()} == {"und"}
