"""Queries over the driver tables, one for each operator of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hmm, kernel, langid, pieces, quality, signature_tree, transducer, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Hosts whose pages make up the list of op3.
BAD_HOSTS = r"://([a-z]+\.)*(spam-farm|cheap-pills|casino-win|free-bets|adult-x|ads-track)\."


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.join(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; listed are the URLs of pages of bad hosts, in whatever spelling they were crawled."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.mark(pages, pages.where(F.col("url").rlike(BAD_HOSTS))).drop("possible")


def op4_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.examples(_table(spark, sf_dir, "conversations"))


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each capture of a crawl of all pages, its nested parts as JSON."""
    rows = warc.assemble(warc.parse(warc.records_of_pages(_table(spark, sf_dir, "pages"))))
    return rows.select("capture_id", "target_uri", "date", *(F.to_json(c).alias(c) for c in ("response", "requests", "metadata")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumn("score", F.round("score", 9))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_hmm_scores, op2_ngram_jaccard_join, op3_url_filter, op4_prefix_targets, op5_warc_transactions,
    op6_quality_rules, op7_benchmark_decontamination, op8_language_id, op9_sentencepiece, op10_token_counts,
)}

#: Words as in kernel.fold_table.
_JACCARD = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS gram
    FROM words WHERE len(w) > 0),
sets AS (SELECT doc_id, md5(string_agg(gram, '|' ORDER BY gram)) AS f, count(*) AS n FROM grams GROUP BY doc_id),
texts AS (SELECT f, min(doc_id) AS text_id, any_value(n) AS n, count(*) AS copies FROM sets GROUP BY f),
own AS (SELECT text_id, n, gram FROM texts JOIN grams ON doc_id = text_id),
shared AS (SELECT x.text_id AS a, y.text_id AS b, count(*) AS c, any_value(x.n) AS p, any_value(y.n) AS q FROM own x JOIN own y ON x.gram = y.gram AND x.text_id <> y.text_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE c / (p + q - c) >= 0.55),
reach(x, y) AS (SELECT text_id, text_id FROM texts UNION SELECT x, b FROM reach JOIN links ON y = a),
classes AS (SELECT x AS text_id, min(y) AS class_id FROM reach GROUP BY x),
counts AS (SELECT a AS text_id, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(t.text_id, d.doc_id) AS text_id, coalesce(copies - 1, 0) AS n_copies, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN texts t USING (f) LEFT JOIN classes c ON c.text_id = t.text_id LEFT JOIN counts k ON k.text_id = t.text_id WHERE d.doc_id IS NOT NULL
"""

_CANONICAL = r"""
CASE WHEN host <> '' THEN host || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/index\.html?$|/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END
"""

_URLS = rf"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '(?s)#.*$', ''), '(?i)^[a-z][a-z0-9+.-]*://|^//', '') AS rest FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@|:(80|443)$', '', 'g'), '^www\.', '') AS host,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS kept FROM a),
c AS (SELECT page_id, url, {_CANONICAL} AS canonical_url FROM b)
SELECT page_id, url, canonical_url, canonical_url IS NOT NULL AND canonical_url IN
    (SELECT canonical_url FROM c WHERE regexp_matches(url, '://([a-z]+\.)*(spam-farm|cheap-pills|casino-win|free-bets|adult-x|ads-track)\.') AND canonical_url IS NOT NULL) AS listed FROM c
"""

_PREFIX_TARGETS = r"""
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER w - 1 AS position,
    coalesce(string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
    FROM conversations WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
e AS (SELECT conv_id, turn, position, position AS n_context, context, coalesce(text, '') AS reply, context || '<|assistant|>' || chr(10) AS head FROM t WHERE role = 'assistant')
SELECT conv_id, turn, position, n_context, context, reply, head || reply || '<|end|>' || chr(10) AS text, length(head) AS train_start, length(head) + length(reply) + 8 AS train_end FROM e
"""


def _part(kind: str, to: str | None, block: str) -> str:
    """JSON of one WARC record of a page in SQL."""
    uid = lambda k: f"'urn:uuid:' || md5('{k}:' || page_id)"
    link = f"""[{{'k': 'warc-concurrent-to', 'v': '<' || {uid(to)} || '>'}}]""" if to else "[]"
    return f"""{{'record_id': {uid(kind)}, 'target_uri': url, 'date': '2024-01-01T00:00:00Z', 'headers': {link} ||
        [{{'k': 'warc-date', 'v': '2024-01-01T00:00:00Z'}}, {{'k': 'warc-record-id', 'v': '<' || {uid(kind)} || '>'}}, {{'k': 'warc-target-uri', 'v': url}}, {{'k': 'warc-type', 'v': '{kind}'}}], 'block': {block}}}"""


_CRLF = "chr(13) || chr(10)"
_WARC = f"""
WITH p AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_replace(url, '^[a-z]+://[^/?#]*|#.*$', '', 'g') AS path FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)
SELECT 'urn:uuid:' || md5('response:' || page_id) AS capture_id, url AS target_uri, '2024-01-01T00:00:00Z' AS date,
    CAST(to_json({_part("response", None, f"'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html' || {_CRLF} || {_CRLF} || html")}) AS VARCHAR) AS response,
    CAST(to_json([{_part("request", "response", f"'GET ' || CASE WHEN path = '' THEN '/' ELSE path END || ' HTTP/1.1' || {_CRLF} || 'Host: ' || host || {_CRLF} || {_CRLF}")}]) AS VARCHAR) AS requests,
    CAST(to_json([{_part("metadata", "request", f"'htmlLength: ' || length(html) || {_CRLF}")}]) AS VARCHAR) AS metadata
FROM p
"""

_M = "18446744073709551616::UHUGEINT"


def _mixed(h: str) -> str:
    """kernel.finish."""
    mixed = f"((xor(({h})::UBIGINT, ({h})::UBIGINT >> 32)::UHUGEINT * {int(kernel._FINISH)}) % {_M})::UBIGINT"
    return f"xor({mixed}, {mixed} >> 29)"


def _polynomial(word: str, code: str) -> str:
    """The polynomial word hash of the kernel in 128-bit arithmetic."""
    return f"list_reduce(list_reverse(list_transform(string_split({word}, ''), lambda c: (({code})::UHUGEINT * {int(kernel._STEP)}) % {_M})), lambda h, v: (h * {kernel._BASE} + v) % {_M})"


_PART = "CASE WHEN {0} > 0 THEN {0} * ln({0} * (m + n) / ((a + b) * {1})) ELSE 0 END"
#: Counted and scored as quality.Rules() and quality.Toxicity() say.
_QUALITY = rf"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '\S+') AS w, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS f FROM documents),
tokens AS (SELECT r, doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words),
vocabulary AS (SELECT w, {_polynomial("w", "unicode(c) + 1")} AS h FROM (SELECT DISTINCT w FROM tokens)),
hashed AS (SELECT r, doc_id, h, lead(h) OVER (PARTITION BY r ORDER BY i) AS g FROM tokens JOIN vocabulary USING (w)),
grams AS (SELECT r, doc_id, ((h + 1) % {_M}) AS h FROM hashed UNION ALL SELECT r, doc_id, ((h * {int(kernel._STEP)} + g + 2) % {_M}) FROM hashed WHERE g IS NOT NULL),
buckets AS (SELECT r, doc_id, {_mixed("h")} >> 48 AS b FROM grams),
counts AS (SELECT b, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)) AS target FROM buckets GROUP BY b),
totals AS (SELECT sum(raw)::DOUBLE AS n, sum(target)::DOUBLE AS t, 65536.0::DOUBLE AS m FROM counts),
ratio AS (SELECT b, ln((target + 16 * (raw + 1) * m / (n + m)) / (t + 16 * m)) - ln((raw + 1) / (n + m)) AS x FROM counts, totals),
scores AS (SELECT r, count(*) AS n_grams, sum(x) / (count(*) + 16) AS score FROM buckets JOIN ratio USING (b) GROUP BY r),
known AS (SELECT doc_id, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 1 AND toxic = 0) GROUP BY doc_id),
labelled AS (SELECT DISTINCT r, toxic, unnest(f) AS w FROM words JOIN known USING (doc_id)),
mixed AS (SELECT r, toxic, w, h FROM labelled JOIN (SELECT w, {_mixed(_polynomial("w", "unicode(c)"))} AS h FROM (SELECT DISTINCT w FROM labelled)) USING (w)),
copies AS (SELECT r, any_value(toxic) AS toxic, {", ".join(f"min({_mixed(f'((h::UHUGEINT + {k}) % {_M})')}) AS l{k}" for k in range(3))} FROM mixed GROUP BY r),
sizes AS (SELECT count(DISTINCT (l0, l1, l2)) FILTER (toxic) AS m, count(DISTINCT (l0, l1, l2)) FILTER (NOT toxic) AS n FROM copies),
often AS (SELECT w, count(DISTINCT (l0, l1, l2)) FILTER (c.toxic)::DOUBLE AS a, count(DISTINCT (l0, l1, l2)) FILTER (NOT c.toxic)::DOUBLE AS b FROM labelled JOIN copies c USING (r) GROUP BY w),
typical AS (SELECT w FROM often, sizes WHERE m > 0 AND n > 0 AND ln((a + 0.5) / (m + 1)) - ln((b + 0.5) / (n + 1)) >= 4.0
    AND 2 * ({_PART.format("a", "m")} + {_PART.format("b", "n")}) >= 2 * ln((SELECT count(*) FROM often))),
hit AS (SELECT DISTINCT r, true AS hit FROM (SELECT r, unnest(f) AS w FROM words) WHERE w IN (SELECT w FROM typical))
SELECT doc_id, coalesce(n_grams, 0) AS n_grams, round(score, 9) AS score, coalesce(hit, false) AS toxic_word, coalesce(score >= -0.05, false) AND hit IS NULL AS keep
FROM words LEFT JOIN scores USING (r) LEFT JOIN hit USING (r)
"""

ORACLES: dict[str, str] = {"op6_quality_rules": _QUALITY, "op2_ngram_jaccard_join": _JACCARD, "op3_url_filter": _URLS, "op4_prefix_targets": _PREFIX_TARGETS, "op5_warc_transactions": _WARC}
