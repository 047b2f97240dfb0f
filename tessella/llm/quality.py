"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over ``2**bits`` hash buckets are counted over *every* word n-gram (n = 1 .. ``orders``;
words split at white space, case and marks kept): ``target`` over the documents labelled good, ``raw``
over all documents.  A document's score is the sum of ``log p_target - log p_raw`` over its n-grams divided
by their number plus ``prior_length``; it is kept if the score is at least ``threshold``.

    p_raw(b)    = (raw_b + 1) / (R + M)
    p_target(b) = (target_b + prior * M * p_raw(b)) / (T + prior * M)

That ratio is diluted by the length of a text, so a text is also rejected if any of its words is typical of documents labelled toxic (:class:`Toxicity`), however
long it is: a second log-likelihood ratio, by word (without case) and document: a word whose share of toxic documents is ``ratio`` (a logarithm) above its
share of trusted ones, and whose log-likelihood ratio statistic is at least twice the logarithm of the number of words looked at.  Near copies (equal MinHash) count as one document.

Defined results: a null, empty or blank text has no n-gram, score null, and is rejected; a repeated row
counts and is scored each time; null labels make no document trusted or toxic; a doc_id with several labels is toxic if one says so; without any trusted document all
scores are 0 and no word is toxic, so every text with a word is kept; a score that ties with the threshold is kept; very long texts are counted and scored whole; empty
tables give empty results; other columns, whatever their names, are ignored by :func:`score` and passed on unread by :func:`accept`.

Plan: two scans of (doc_id, text), one shuffle of at most ``2**bits`` rows a task; no text is moved.  :class:`Toxicity` adds a scan and a shuffle of the
distinct words of each labelled document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel

#: Trusted ids up to this number go to the tasks as a sorted array (8 bytes each); beyond it a shuffled join marks the documents.
ID_ARRAY_LIMIT = 4_000_000


@dataclass(frozen=True)
class Rules:
    bits: int = 16
    orders: int = 2
    prior: float = 16.0
    prior_length: float = 16.0
    threshold: float = -0.05


@dataclass(frozen=True)
class Toxicity:
    ratio: float = 4.0


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known``, which is sorted."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _buckets(texts: list[str], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram."""
    words = kernel.Words(texts, kernel.token_table())
    ids, owner = [], []
    for n in range(1, rules.orders + 1):
        h, bounds = kernel.ngrams(words, n)
        ids.append((h >> np.uint64(64 - rules.bits)).astype(np.int64))
        owner.append(np.repeat(np.arange(len(texts)), np.diff(bounds)))
    return np.concatenate(ids), np.concatenate(owner)


def count_buckets(docs: DataFrame, trusted: DataFrame, rules: Rules) -> DataFrame:
    """(bucket, raw, target): the counts over all documents; ``trusted`` has one distinct column doc_id."""
    spark, marked = docs.sparkSession, None
    head = [r[0] for r in trusted.limit(ID_ARRAY_LIMIT + 1).toLocalIterator()]
    if len(head) <= ID_ARRAY_LIMIT:
        marked = spark.sparkContext.broadcast(np.sort(np.array(head, np.int64)))
        rows = docs.select("doc_id", "text")
    else:
        rows = docs.select("doc_id", "text").join(trusted.withColumn("is_trusted", F.lit(True)), "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << rules.bits
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for part, texts in kernel.slices(batch):
                ids, owner = _buckets(texts, rules)
                if marked is None:
                    good = part.column("is_trusted").fill_null(False).to_numpy(zero_copy_only=False)
                else:
                    known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                    good = _among(part.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(), marked.value) & known
                raw += np.bincount(ids, minlength=size)
                target += np.bincount(ids[good[owner]], minlength=size)
        some = np.flatnonzero(raw)
        yield pa.record_batch({"bucket": some.astype(np.int32), "raw": raw[some], "target": target[some]})

    return rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def weights(counts: DataFrame, rules: Rules) -> np.ndarray:
    """Log-likelihood ratio by bucket; the driver gets at most ``2**bits`` rows."""
    table = counts.toArrow()
    size = 1 << rules.bits
    raw, target = np.zeros(size), np.zeros(size)
    at = table.column("bucket").to_numpy()
    raw[at], target[at] = table.column("raw").to_numpy(), table.column("target").to_numpy()
    if not target.any():
        return np.zeros(size)
    p_raw = (raw + 1) / (raw.sum() + size)
    p_target = (target + rules.prior * size * p_raw) / (target.sum() + rules.prior * size)
    return np.log(p_target) - np.log(p_raw)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents with a label of good quality and none of toxicity."""
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()


def _word_rows(texts: list[str], toxic: np.ndarray) -> pa.RecordBatch:
    """(word, toxic, copy): the distinct words of each text, and a null word for the text itself; ``copy`` is the same for near copies."""
    words = kernel.Words(texts)
    h, some = kernel.finish(words.raw), np.flatnonzero(words.counts())
    copy = np.zeros(len(some), np.uint64)
    for salt in range(3 * bool(len(some))):
        least = np.minimum.reduceat(kernel.finish(h + np.uint64(salt)), words.bounds[:-1][some])
        copy = kernel.finish(copy + least)
    owner = np.repeat(np.arange(len(some)), words.counts()[some])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.concatenate([owner[new], np.arange(len(some))])
    word = np.concatenate([h[new], np.zeros(len(some), np.uint64)]).view(np.int64)
    return pa.record_batch({"word": pa.array(word, mask=np.arange(len(at)) >= new.sum()), "toxic": toxic[some][at], "copy": copy.view(np.int64)[at]})


def toxic_words(docs: DataFrame, labels: DataFrame, toxicity: Toxicity) -> np.ndarray:
    """Hashes of the words that are typical of toxic documents; the driver gets no others."""
    spark, marked = docs.sparkSession, None
    kernel.shared_checkpoints(spark)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"), F.max(F.expr("coalesce(quality = 1 and toxic = 0, false)")).alias("good")
    ).where("toxic or good").select("doc_id", "toxic")
    head = known.limit(ID_ARRAY_LIMIT + 1).toArrow()
    if len(head) <= ID_ARRAY_LIMIT:
        ids, toxic = head.column("doc_id").to_numpy(), head.column("toxic").to_numpy()
        marked = spark.sparkContext.broadcast((np.sort(ids), np.sort(ids[toxic])))
        rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    else:
        rows = docs.select(F.col("doc_id").cast("long"), "text").join(known, "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in kernel.slices(batch):
                if marked is None:
                    yield _word_rows(texts, part.column("toxic").to_numpy(zero_copy_only=False))
                else:
                    ids = part.column("doc_id").to_numpy()
                    at = np.flatnonzero(_among(ids, marked.value[0]))
                    yield _word_rows([texts[i] for i in at], _among(ids[at], marked.value[1]))

    each = rows.mapInArrow(count, "word long, toxic boolean, copy long").distinct()
    table = each.groupBy("word").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b")).checkpoint()
    total = table.where("word is null").first()
    if total is None or not total["a"] or not total["b"]:
        return np.zeros(0, np.int64)
    m, n = total["a"], total["b"]
    part = lambda x, of: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) * (m + n) / ((F.col("a") + F.col("b")) * of))).otherwise(0.0)
    typical = F.log((F.col("a") + 0.5) / (m + 1)) - F.log((F.col("b") + 0.5) / (n + 1)) >= toxicity.ratio
    least = 2 * np.log(max(1, table.where("word is not null").count()))
    found = table.where("word is not null").where(typical & (2 * (part("a", m) + part("b", n)) >= float(least))).select("word").toArrow()
    return np.sort(found.column("word").to_numpy())


Scores = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _scorer(docs: DataFrame, labels: DataFrame, rules: Rules, toxicity: Toxicity | None) -> Callable[[list[str]], Scores]:
    """Of texts: scores, numbers of n-grams, which are toxic, which are kept."""
    context = docs.sparkSession.sparkContext
    ratio = context.broadcast(weights(count_buckets(docs, trusted_ids(labels), rules), rules))
    bad = context.broadcast(toxic_words(docs, labels, toxicity) if toxicity else np.zeros(0, np.int64))

    def scores(texts: list[str]) -> Scores:
        ids, owner = _buckets(texts, rules)
        grams = np.bincount(owner, minlength=len(texts))
        s = np.bincount(owner, weights=ratio.value[ids], minlength=len(texts)) / np.maximum(grams + rules.prior_length, 1)
        toxic = np.zeros(len(texts), bool)
        if len(bad.value):
            words = kernel.Words(texts)
            hit = _among(kernel.finish(words.raw).view(np.int64), bad.value)
            toxic[np.repeat(np.arange(len(texts)), words.counts())[hit]] = True
        return s, grams, toxic, (s >= rules.threshold) & (grams > 0) & ~toxic

    return scores


def score(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), toxicity: Toxicity | None = Toxicity()) -> DataFrame:
    """(doc_id, n_grams, score, toxic_word, keep) of every row of ``docs``."""
    scores = _scorer(docs, labels, rules, toxicity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in kernel.slices(batch):
                s, grams, toxic, keep = scores(texts)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_grams": grams.astype(np.int64), "score": pa.array(s, mask=grams == 0), "toxic_word": toxic, "keep": keep})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_grams long, score double, toxic_word boolean, keep boolean")


def accept(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), toxicity: Toxicity | None = Toxicity()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    scores = _scorer(docs, labels, rules, toxicity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in kernel.slices(batch):
                yield part.filter(pa.array(scores(texts)[3]))

    return docs.mapInArrow(run, docs.schema)
