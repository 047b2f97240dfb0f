"""Queries over the driver tables, one or more for each group of operators, with the SQL that gives the same rows."""

from __future__ import annotations

import dataclasses
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import arrays as A
from .functions import text as T
from .operators import batching, decisions, quality, shards, speakers, universe
from .plans import materialize, store, synthesis
from .rowmap import Item, samples
from .streaming.snapshots import Catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VOICES = ("Ryan", "Vivian", "Ada")
LANGS = ("en", "fr", "de", "es")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder that all executors share: the cluster's, or in local mode, where there is one machine, one of our own if it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or tempfile.gettempdir()
    return f"{base.removeprefix('file://')}/tessella-{name}-{uuid.uuid4().hex}"


def texts(spark: SparkSession, sf: str, role: str = "default") -> DataFrame:
    """documents as canonical samples."""
    rows = table(spark, sf, "documents").withColumn("sample_index", F.col("doc_id")).withColumn("sample_id", universe.sample_id(F.col("doc_id"), F.lit("doc")))
    return samples(rows, [(f"{role}_text", Item({"text": "text"}, {"lang": "lang", "source_index": "doc_id"}))])


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as (user turn, next assistant turn)."""
    c = table(spark, sf, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    rows = a.join(b, ["conv_id", "turn"]).withColumn("sample_index", F.col("conv_id") * 1000 + F.col("turn"))
    return samples(rows, [("source_text", Item({"text": "source"}, constants={"lang": "en"})), ("target_text", Item({"text": "target"}, constants={"lang": "fr"}))])


_PAIRS = """a AS (SELECT u.conv_id * 1000 + u.turn AS sample_index, u.text AS s, v.text AS t FROM conversations u
    JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user' AND v.role = 'assistant')"""
_RUNS = """chars AS (SELECT doc_id, unnest(string_split(n, '')) AS c, generate_subscripts(string_split(n, ''), 1) AS i FROM norm),
    marks AS (SELECT doc_id, i, (c IS DISTINCT FROM lag(c) OVER (PARTITION BY doc_id ORDER BY i))::INT AS f FROM chars),
    groups AS (SELECT doc_id, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marks),
    runs AS (SELECT doc_id, max(n) AS repeated_run FROM (SELECT doc_id, g, count(*) AS n FROM groups GROUP BY ALL) GROUP BY doc_id)"""
_NORM = r"norm AS (SELECT doc_id, lang, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS n FROM documents)"
_TAG, _SLOT, _NUM = T.TAG, f"{T.BRACED}|{T.DOLLAR}", T.NUMBER
_BARE = rf"regexp_replace(regexp_replace(regexp_replace(n, '{_TAG}', ' ', 'g'), '{_SLOT}', ' ', 'g'), '{_NUM}', ' ', 'g')"
_METRICS = rf"""{_NORM}, {_RUNS},
    m AS (SELECT doc_id, lang, length(regexp_replace(n, '\s', '', 'g')) AS chars, len(regexp_extract_all(n, '{_NUM}')) AS n_numbers,
        length({_BARE}) - length(regexp_replace({_BARE}, '\p{{L}}', '', 'g')) AS script_chars,
        length({_BARE}) - length(regexp_replace({_BARE}, '\p{{Latin}}', '', 'g')) AS latin FROM norm)"""


_ODD_TEXT = "CASE WHEN doc_id % 3 = 0 THEN text || chr(8203) || chr(7) || chr(173) ELSE text END"
_ODD_METRICS = _METRICS.replace("FROM documents)", f"FROM (SELECT doc_id, lang, {_ODD_TEXT} AS text FROM documents))")


@query(rf"""WITH {_ODD_METRICS} SELECT doc_id, chars, round((length(n) - length(regexp_replace(n, '[\p{{Cc}}\p{{Cf}}\p{{Co}}]', '', 'g')))::DOUBLE / length(n), 9) AS control_ratio, coalesce(repeated_run, 0) AS repeated_run, n_numbers, script_chars,
    round(latin::DOUBLE / nullif(script_chars, 0), 9) AS script_ratio FROM m LEFT JOIN runs USING (doc_id) JOIN norm USING (doc_id)""")
def text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, every third with three characters of the control categories at its end."""
    odd = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\u200b\x07\xad"))).otherwise(F.col("text"))
    m = table(spark, sf, "documents").select("doc_id", T.metrics(odd, "en").alias("m"))
    m = m.withColumn("m", F.col("m").withField("control_ratio", F.round("m.control_ratio", 9)))
    return m.select("doc_id", "m.chars", "m.control_ratio", "m.repeated_run", F.size("m.numbers").cast("long").alias("n_numbers"), "m.script_chars", F.round("m.script_ratio", 9).alias("script_ratio"))


_VALUE = rf"""CASE WHEN regexp_full_match(k, '{T.GROUPED}') OR regexp_full_match(k, '{T.DECIMAL}') THEN
    CASE WHEN k LIKE '-%' THEN '-' ELSE '' END || coalesce(nullif(ltrim(regexp_extract(replace(k, ',', ''), '^[+-]?(\d+)', 1), '0'), ''), '0')
    || CASE WHEN rtrim(regexp_extract(k, '\.(\d+)$', 1), '0') = '' THEN '' ELSE '.' || rtrim(regexp_extract(k, '\.(\d+)$', 1), '0') END ELSE k END"""


@query(rf"SELECT doc_id, k AS token, {_VALUE} AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_NUM}')) AS k FROM documents)")
def number_values(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "documents").select("doc_id", F.explode(T.numbers(F.col("text"))).alias("token"))
    return tokens.select("doc_id", "token", T.number_value(F.col("token")).alias("value"))


@query(rf"SELECT k AS tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '{_TAG.replace('a-zA-Z', 'a-z')}')) AS k FROM pages) GROUP BY k")
def html_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "pages").select("page_id", F.explode(T.html_tags(F.col("html"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '\{[^{}]+\}|\$\d+')) AS n_placeholders FROM pages")
def placeholders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.size(T.placeholders(F.col("html"))).cast("long").alias("n_placeholders"))


_FLAGS = f"""{_METRICS}, f AS (SELECT doc_id, list_filter([CASE WHEN lang <> 'en' THEN 'default_lang_mismatch' END, CASE WHEN chars < 1 THEN 'default_empty_text' END,
    CASE WHEN repeated_run >= 24 THEN 'default_long_repeated_run' END, CASE WHEN script_chars >= 4 AND latin::DOUBLE / script_chars < 0.2 THEN 'default_script_mismatch' END,
    CASE WHEN script_chars >= 4 AND latin::DOUBLE / script_chars >= 0.2 AND latin::DOUBLE / script_chars < 0.45 THEN 'default_script_low' END], lambda x: x IS NOT NULL) AS flags
    FROM m LEFT JOIN runs USING (doc_id)),
    tq AS (SELECT doc_id, CASE WHEN len(flags) > 0 THEN 'reject' ELSE 'accept' END AS label, array_to_string(flags, ',') AS flags FROM f)"""


@query(f"WITH {_FLAGS} SELECT doc_id, label, flags FROM tq")
def text_quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.TextQuality(lang="en")(texts(spark, sf))
    return out.select(F.col("sample_index").alias("doc_id"), "text_quality.label", F.array_join("text_quality.flags", ",").alias("flags"))


@query(f"WITH {_FLAGS} SELECT label, count(*) AS count FROM tq GROUP BY label")
def text_quality_counts(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.label_counts(quality.TextQuality(lang="en")(texts(spark, sf)).select("text_quality.label"))


def _label(spark: SparkSession, sf: str) -> DataFrame:
    """documents with the label of the labels table, null where there is none."""
    known = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("bad").alias("label"), "quality", "toxic")
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(known, "doc_id", "left").withColumnRenamed("doc_id", "sample_index")


_LAB = """lab AS (SELECT d.doc_id AS sample_index, lang, n_chars, quality, toxic,
    CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(f"WITH {_LAB} SELECT sample_index, coalesce(label, 'review') AS label FROM lab WHERE coalesce(label, 'review') IN ('good', 'review')")
def label_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """A rule applied to the whole universe, published by label, two of its labels read again."""
    rows = _label(spark, sf).withColumn("sample_id", F.col("sample_index").cast("string"))
    rule = decisions.FilterRule("labels", lambda d: d.withColumn("label", F.coalesce("label", F.lit("review"))))
    done = rule.apply(universe.Universe.of(rows, sf), scratch(spark, "labels"))
    return done.decisions().where(F.col("label").isin("good", "review")).select("sample_index", "label")


@query(f"""WITH {_LAB}, r AS (SELECT sample_index, CASE WHEN lang = 'en' THEN 'accept' ELSE 'reject' END AS a, CASE WHEN coalesce(toxic, 0) = 1 THEN 'reject' WHEN label IS NULL THEN 'review' ELSE 'accept' END AS b,
    CASE WHEN n_chars > 2000 THEN 'reject' ELSE 'accept' END AS c FROM lab),
    s AS (SELECT *, CASE WHEN b = 'reject' THEN 'reject' WHEN a = 'reject' AND b = 'accept' THEN 'review' WHEN a = 'accept' AND b = 'review' THEN 'review' ELSE a END AS ab FROM r)
    SELECT sample_index, CASE WHEN c = 'reject' THEN 'reject' WHEN ab = 'reject' AND c = 'accept' THEN 'review' ELSE ab END AS label FROM s""")
def quality_chain_fold(spark: SparkSession, sf: str) -> DataFrame:
    class Rule:
        def __init__(self, name, label):
            self.name, self.label = name, label

        def __call__(self, rows):
            return rows.withColumn(self.name, F.struct(self.label.alias("label"), F.array().cast("array<string>").alias("flags")))

    lang = F.when(F.col("lang") == "en", "accept").otherwise("reject")
    toxic = F.when(F.coalesce("toxic", F.lit(0)) == 1, "reject").when(F.col("label").isNull(), "review").otherwise("accept")
    size = F.when(F.col("n_chars") > 2000, "reject").otherwise("accept")
    out = quality.QualityChain((Rule("a", lang), Rule("b", toxic), Rule("c", size)))(_label(spark, sf))
    return out.select("sample_index", "quality.label")


def _selection(spark: SparkSession, sf: str) -> universe.Selection:
    return universe.Selection(_label(spark, sf)).also(universe.select_labels(F.col("label"), "good", "toxic")).also(F.col("lang") == "en")


@query(f"WITH {_LAB} SELECT sample_index, (label IN ('good', 'toxic')) AND lang = 'en' AS selected FROM lab")
def selection_intersection(spark: SparkSession, sf: str) -> DataFrame:
    s = _selection(spark, sf)
    return s.universe.select("sample_index", s.selected.alias("selected"))


@query(f"WITH {_LAB} SELECT sample_index FROM lab WHERE ((label IN ('good', 'toxic')) AND lang = 'en') IS NULL")
def selection_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return _selection(spark, sf).unknown_indices()


@query("SELECT doc_id AS sample_index, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents WHERE lang = 'fr'")
def selected_positions(spark: SparkSession, sf: str) -> DataFrame:
    return universe.Selection(_label(spark, sf), (F.col("lang") == "fr",)).rows().select("sample_index", F.col("position").cast("long").alias("position"))


@query("SELECT doc_id AS k FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 1 OFFSET 7")
def selected_index_k(spark: SparkSession, sf: str) -> DataFrame:
    """The eighth selected sample (the k is the feature)."""
    k = universe.Selection(_label(spark, sf), (F.col("lang") == "fr",)).selected_index(7)
    return spark.createDataFrame([(k,)], "k long")


@query(f"WITH {_LAB} SELECT sample_index >= 0 AND sample_index < 300 AND coalesce(label IN ('good'), false) AS selected, sample_index FROM lab")
def published_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Selection by decisions published up to sample 300 (the window is the feature)."""
    return _label(spark, sf).select("sample_index", universe.prefix_selected(F.col("sample_index"), F.col("label"), 300, "good").alias("selected"))


@query(f"WITH {_LAB}, n AS (SELECT *, row_number() OVER (ORDER BY n_chars, sample_index) - 1 AS k FROM lab) SELECT k AS sample_index, label FROM n")
def rebase_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _label(spark, sf).withColumn("sample_id", F.col("sample_index").cast("string"))
    target = universe.number_rows(rows.drop("label").withColumnRenamed("sample_index", "old"), ["n_chars", "old"]).select("sample_id", "sample_index")
    return universe.rebase(rows.select("sample_index", "label"), rows, target)


@query(f"WITH {_LAB}, n AS (SELECT *, row_number() OVER (ORDER BY sample_index) - 1 AS k FROM lab WHERE lang = 'de') SELECT k AS sample_index, label FROM n")
def project_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _label(spark, sf).withColumn("sample_id", F.col("sample_index").cast("string"))
    target = universe.number_rows(rows.where("lang = 'de'").drop("label").withColumnRenamed("sample_index", "old"), ["old"]).select("sample_id", "sample_index")
    return universe.project(rows.select("sample_index", "label"), rows, target)


@query(f"""WITH {_LAB}, n AS (SELECT *, row_number() OVER (ORDER BY n_chars, sample_index) - 1 AS k FROM lab) SELECT k AS sample_index, (label IN ('good', 'toxic')) AND lang = 'en' AS selected FROM n""")
def rebase_selection(spark: SparkSession, sf: str) -> DataFrame:
    s = _selection(spark, sf)
    rows = s.universe.withColumn("sample_id", F.col("sample_index").cast("string"))
    target = universe.number_rows(rows.select("sample_id", "n_chars", F.col("sample_index").alias("old")), ["n_chars", "old"]).select("sample_id", "sample_index")
    return universe.rebase_selection(rows.select("sample_index", s.selected.alias("selected")), rows, target)


@query("""SELECT doc_id AS sample_index, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'lang' END, CASE WHEN doc_id % 7 = 0 THEN 'parts' END, CASE WHEN doc_id % 11 = 0 THEN 'text' END], lambda x: x IS NOT NULL), ',') AS columns
    FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0""")
def deep_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against a version of which some fields, nested ones too, are changed or nulled."""
    left = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_index"), "lang", "text", F.struct("n_chars", F.array("source", F.lit(None)).alias("x")).alias("parts"))
    every = lambda k: F.col("sample_index") % k == 0
    parts = F.col("parts").withField("x", F.when(every(7), F.array(F.lit(None), F.col("parts.x")[0])).otherwise(F.col("parts.x")))
    right = left.select("sample_index", F.when(every(5), "xx").otherwise(F.col("lang")).alias("lang"), F.when(~every(11), F.col("text")).alias("text"), parts.alias("parts"))
    return universe.differing(left, right).select("sample_index", F.array_join("columns", ",").alias("columns"))


@query("""SELECT doc_id AS sample_index, '[[["default","text"],{"lang":"' || lang || '","source_index":' || doc_id || '}]]' AS items FROM documents""")
def items_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = texts(spark, sf)
    return rows.select("sample_index", S.items_json(rows).alias("items"))


@query("SELECT o_orderkey AS global_index, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_index FROM orders WHERE o_orderstatus = 'F'")
def index_selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "sample_index")
    picked = rows.where("o_orderstatus = 'F'").select("sample_index")
    count = rows.agg(F.max("sample_index") + 1).first()[0]
    return universe.index_selection(rows.select("sample_index", "o_totalprice"), picked, count).select("global_index", "o_totalprice", "sample_index")


@query("SELECT l_shipdate, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS sample_index FROM lineitem")
def dense_numbers(spark: SparkSession, sf: str) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return universe.number_rows(table(spark, sf, "lineitem"), order).select("l_shipdate", "l_orderkey", "l_linenumber", "sample_index")


@query("SELECT event_id % 8 AS shard, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def modulo_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All eight shards of the events."""
    rows = table(spark, sf, "events")
    out = None
    for k in range(8):
        part = shards.modulo_shard(rows, 8, k, "event_id").agg(F.lit(k).cast("long").alias("shard"), F.count("*").alias("n"), F.sum("value").alias("total"))
        out = part if out is None else out.union(part)
    return out


@query("SELECT event_id, event_id % 7 AS shard FROM events WHERE event_id < (SELECT count(*) FROM events) // 7 * 7")
def runtime_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    n = rows.count()
    out = None
    for k in range(7):
        part = shards.runtime_shard(rows, 7, k, n, "event_id").select("event_id", F.lit(k).cast("long").alias("shard"))
        out = part if out is None else out.union(part)
    return out


@query("SELECT event_id % 5 AS shard, count(*) AS n FROM events GROUP BY 1")
def shard_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Each of five shards checked to be whole and dense, and its number of rows."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("sample_index"))
    total = rows.count()
    found = [(k, shards.check_shard_output(shards.modulo_shard(rows, 5, k), 5, k, total)) for k in range(5)]
    return spark.createDataFrame(found, "shard long, n long")


@query("SELECT doc_id AS sample_index, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS before FROM documents")
def prefix_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Characters before each document."""
    return shards.prefix_sums(table(spark, sf, "documents").select(F.col("doc_id").alias("sample_index"), "n_chars"), "sample_index", "n_chars", block=256).select("sample_index", "before")


@query(f"""WITH {_LAB}, p AS (SELECT sample_index, row_number() OVER (ORDER BY sample_index) - 1 AS position FROM lab WHERE lang = 'en')
    SELECT sample_index, position, sample_index // 256 AS "group", dense_rank() OVER (ORDER BY sample_index // 256) AS n_groups FROM p""")
def selected_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Shuffle groups over a selection's positions (SQL knows which rows are together, tests know the order)."""
    chosen = universe.Selection(_label(spark, sf), (F.col("lang") == "en",)).rows().select("sample_index", "position")
    out = shards.selected_groups(chosen, 7, 0, size=256)
    rank = universe.number_rows(out.select("group").distinct(), ["group"], "n_groups").withColumn("n_groups", F.col("n_groups") + 1)
    return out.join(rank, "group").select("sample_index", F.col("position").cast("long").alias("position"), "group", "n_groups")


@query("""WITH w AS (SELECT user_id, count(*) AS s, count(DISTINCT event_type) AS c, sum(value) AS t, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY user_id)
    SELECT count(*) AS worker_count, sum(s)::BIGINT AS filter_samples, sum(c)::BIGINT AS filter_calls, round(sum(t), 2) AS filter_seconds, min(lo) AS batch_size_min, max(hi) AS batch_size_max, round(sum(s) / sum(c), 6) AS batch_size_mean,
    round(sum(s) / sum(t), 6) AS filter_samples_per_second, round(sum(t), 2) AS elapsed_seconds_sum, round(max(t), 2) AS elapsed_seconds_max FROM w""")
def worker_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Users of the events as workers."""
    w = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("samples"), F.countDistinct("event_type").alias("calls"), F.sum("value").alias("seconds"), F.min("event_id").alias("batch_size_min"), F.max("event_id").alias("batch_size_max"))
    out = shards.worker_summary(w.withColumn("elapsed_seconds", F.col("seconds")))
    places = {"filter_seconds": 2, "elapsed_seconds_sum": 2, "elapsed_seconds_max": 2, "batch_size_mean": 6, "filter_samples_per_second": 6}
    return out.select(*(F.round(c, places[c]).alias(c) if c in places else c for c in out.columns))


@query("SELECT event_id AS sample_index FROM events WHERE event_type <> 'click'")
def missing_indexes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return shards.missing_indexes(spark, rows.where("event_type = 'click'").withColumnRenamed("event_id", "sample_index"), rows.count())


_ISLANDS = "SELECT event_type, min(event_id) AS start, max(event_id) AS stop, count(*) AS count FROM (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events) GROUP BY event_type, g"


@query(_ISLANDS)
def index_islands(spark: SparkSession, sf: str) -> DataFrame:
    return shards.runs(table(spark, sf, "events"), "event_id", ["event_type"])


@query("""WITH d AS (SELECT user_id, event_id, lead(event_id) OVER w - event_id AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    n AS (SELECT *, coalesce((d <> lag(d) OVER w)::INT, 1) AS f FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM n)
    SELECT user_id, min(event_id) AS start, coalesce(min(d), 1) AS step, count(*) AS count FROM r GROUP BY user_id, r""")
def payload_runs(spark: SparkSession, sf: str) -> DataFrame:
    return shards.steps(table(spark, sf, "events"), "event_id", ["user_id"])


_PAIR_FLAGS = rf"""WITH {_PAIRS}, n AS (SELECT sample_index, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM a),
    m AS (SELECT *, length(replace(s, ' ', '')) AS sc, length(replace(t, ' ', '')) AS tc, CASE WHEN length(replace(s, ' ', '')) = 0 THEN 0.0 ELSE length(replace(t, ' ', ''))::DOUBLE / length(replace(s, ' ', '')) END AS r,
        list_sort(list_transform(regexp_extract_all(s, '{_NUM}'), lambda k: {_VALUE})) AS sn, list_sort(list_transform(regexp_extract_all(t, '{_NUM}'), lambda k: {_VALUE})) AS tn,
        list_sort(regexp_extract_all(s, '{_NUM}')) AS st, list_sort(regexp_extract_all(t, '{_NUM}')) AS tt FROM n),
    o AS (SELECT *, len(list_filter(st || tt, lambda k: NOT regexp_full_match(k, '{T.GROUPED}') AND NOT regexp_full_match(k, '{T.DECIMAL}'))) > 0
        OR regexp_matches(s || ' ' || t, '(?i){T.PERIODS}') AS odd FROM m),
    f AS (SELECT sample_index, r, list_filter([CASE WHEN r < 0.05 THEN 'target_extremely_short' END, CASE WHEN r >= 0.05 AND r < 0.2 THEN 'target_short' END, CASE WHEN r > 20 THEN 'target_extremely_long' END,
        CASE WHEN r > 6 AND r <= 20 THEN 'target_long' END, CASE WHEN lower(s) = lower(t) THEN 'identical_text' END,
        CASE WHEN list_sort(regexp_extract_all(s, '{_SLOT}')) <> list_sort(regexp_extract_all(t, '{_SLOT}')) THEN 'placeholder_mismatch' END,
        CASE WHEN list_sort(regexp_extract_all(lower(s), '{_TAG}')) <> list_sort(regexp_extract_all(lower(t), '{_TAG}')) THEN 'html_tag_mismatch' END,
        CASE WHEN odd THEN 'complex_numbers' END, CASE WHEN NOT odd AND sn <> tn THEN 'number_value_mismatch' END, CASE WHEN NOT odd AND sn = tn AND st <> tt THEN 'number_surface_mismatch' END], lambda x: x IS NOT NULL) AS flags FROM o)
    SELECT sample_index, CASE WHEN len(list_filter(flags, lambda x: x <> 'number_surface_mismatch')) > 0 THEN 'reject' ELSE 'accept' END AS label, array_to_string(flags, ',') AS flags, round(r, 9) AS char_ratio FROM f"""


@query(_PAIR_FLAGS)
def translation_quality(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.TranslationQuality(quality.PairProfile("en", "fr"))(pairs(spark, sf))
    q = "translation_quality"
    return out.select("sample_index", f"{q}.label", F.array_join(f"{q}.flags", ",").alias("flags"), F.round(f"{q}.char_ratio", 9).alias("char_ratio"))


@query()
def zh_en_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The Chinese-English number path over all pairs (tested on literal cases)."""
    from .functions.numbers import zh_en

    p = pairs(spark, sf)
    return p.select("sample_index", zh_en(False)(T.normalize_space(F.col("source_text.views.text")), T.normalize_space(F.col("target_text.views.text"))).alias("n")).select("sample_index", "n.source", "n.target", "n.unsupported")


@query(rf"""WITH {_PAIRS}, w AS (SELECT sample_index, 1 AS side, unnest(string_split(s, ' ')) AS w FROM a UNION ALL SELECT sample_index, 2, unnest(string_split(t, ' ')) FROM a),
    c AS (SELECT sample_index, w, count(*) FILTER (side = 1) AS x, count(*) FILTER (side = 2) AS y FROM w GROUP BY ALL)
    SELECT sample_index, round(sum(least(x, y))::DOUBLE / sum(greatest(x, y)), 9) AS overlap FROM c GROUP BY sample_index""")
def multiset_overlap(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda c: F.split(F.col(f"{c}_text.views.text"), " ")
    return pairs(spark, sf).select("sample_index", F.round(T.overlap(words("source"), words("target")), 9).alias("overlap"))


_ACC = "acc AS (SELECT d.doc_id AS sample_index, coalesce(quality = 1, true) AS accepted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"""WITH {_ACC}, n AS (SELECT count(*) AS n FROM acc), d AS (SELECT sample_index AS i, accepted, sample_index AS own FROM acc UNION ALL SELECT sample_index + n.n, accepted, sample_index FROM acc, n WHERE sample_index < 32)
    SELECT i AS sample_index, accepted, first_value(CASE WHEN accepted THEN own END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 32 FOLLOWING) AS served FROM d QUALIFY i < (SELECT n FROM n)""")
def next_accepted(spark: SparkSession, sf: str) -> DataFrame:
    rows = _label(spark, sf).select("sample_index", F.coalesce(F.col("quality") == 1, F.lit(True)).alias("accepted"))
    return shards.next_accepted(rows, rows.count())


_BLOCKS = "acc AS (SELECT doc_id AS sample_index, doc_id % 100 < 50 AS accepted FROM documents)"


@query(f"""WITH {_BLOCKS}, n AS (SELECT count(*) AS n FROM acc), d AS (SELECT sample_index AS i, accepted, sample_index AS own FROM acc UNION ALL SELECT sample_index + n.n, accepted, sample_index FROM acc, n WHERE sample_index < 32),
    s AS (SELECT i AS sample_index, accepted, first_value(CASE WHEN accepted THEN own END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 32 FOLLOWING) AS served FROM d QUALIFY i < (SELECT n FROM n)),
    b AS (SELECT *, sum(accepted::INT) OVER (ORDER BY sample_index) - accepted::INT AS k FROM s)
    SELECT b.sample_index, b.accepted, coalesce(b.served, a.sample_index) AS served FROM b LEFT JOIN b a ON a.accepted AND b.served IS NULL AND a.k = b.k - 1 - (b.sample_index * 2654435761 + 5) % greatest(least(b.k, 16), 1)""")
def replace_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which every other run of fifty is rejected: neighbours, then the buffer, take their places."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_index"), (F.col("doc_id") % 100 < 50).alias("accepted"))
    return shards.replace_rejected(rows, rows.count(), buffer_size=16, seed=5)


@query(f"""WITH {_BLOCKS}, r AS (SELECT *, avg(CASE WHEN accepted THEN 0.0 ELSE 1.0 END) OVER (ORDER BY sample_index ROWS 79 PRECEDING) AS x FROM acc)
    SELECT sample_index, round(x, 9) AS reject_ratio, CASE WHEN x >= 0.6 THEN 'error' ELSE 'warn' END AS level FROM r WHERE sample_index >= 79 AND NOT accepted AND x >= 0.4""")
def reject_alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_index"), (F.col("doc_id") % 100 < 50).alias("accepted"))
    return shards.reject_alerts(rows, 0.4, 0.6, 80).select("sample_index", F.round("reject_ratio", 9).alias("reject_ratio"), "level")


@query(f"WITH {_ACC} SELECT sample_index, round(avg(CASE WHEN accepted THEN 0.0 ELSE 1.0 END) OVER (ORDER BY sample_index ROWS 199 PRECEDING), 9) AS reject_ratio FROM acc")
def rolling_reject_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = _label(spark, sf).select("sample_index", F.coalesce(F.col("quality") == 1, F.lit(True)).alias("accepted"))
    return shards.rolling_reject_ratio(rows).select("sample_index", F.round("reject_ratio", 9).alias("reject_ratio"))


@query("WITH p AS (SELECT doc_id AS sample_index, doc_id // 4096 AS g, row_number() OVER (PARTITION BY doc_id // 4096 ORDER BY doc_id) - 1 AS k FROM documents) SELECT g AS \"group\", k // 16 AS batch, k % 16 AS position, sample_index FROM p")
def unit_cost_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batching.unit_batches(texts(spark, sf), batching.Plan(16), shards.group_of(F.col("sample_index")))


@query()
def cost_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of documents by their length (a sequential plan; tested against an exhaustive model).  A document without characters costs 1, as costs must be positive."""
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "sample_index")
    cost = F.greatest("n_chars", F.lit(1))  # passes over nulls
    budget = docs.agg(F.max(cost)).first()[0] or 1
    planned = batching.plan_batches(docs, cost, batching.Plan(int(budget)), shards.group_of(F.col("sample_index")))
    return batching.batch_summary(planned)


@query("""WITH b AS (SELECT event_id, event_id % 3 AS rank, (event_id // 3) // CASE WHEN event_id % 3 = 0 THEN 10 ELSE 12 END AS batch FROM events),
    l AS (SELECT min(n) AS n FROM (SELECT rank, max(batch) + 1 AS n FROM b GROUP BY rank)) SELECT event_id, rank, batch FROM b, l WHERE batch < n""")
def rank_trim(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 3).alias("rank"), F.floor(F.floor(F.col("event_id") / 3) / F.when(F.col("event_id") % 3 == 0, 10).otherwise(12)).alias("batch"))
    return shards.rank_trim(e, F.col("rank"), F.col("batch"))


@query("""WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS v FROM conversations), m AS (SELECT conv_id, max(len(v)) AS l FROM w GROUP BY conv_id)
    SELECT conv_id, turn, len(v) AS length, l - len(v) AS padding, list_sum(v) AS total FROM w JOIN m USING (conv_id)""")
def pad_and_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Word lengths of each conversation's turns, padded to a rectangle with a mask."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), F.length).alias("v"))
    out = batching.collate_arrays(c, ["conv_id"], "turn", "v", F.lit(0))
    each = out.select("conv_id", F.posexplode(F.arrays_zip("v", "mask", "lengths")).alias("k", "x"))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    real = A.masked_length(F.col("x.mask"))
    return each.join(turns, "conv_id").select("conv_id", F.get("turns", F.col("k")).alias("turn"), F.col("x.lengths").alias("length"), (F.size("x.mask") - real).cast("long").alias("padding"), F.aggregate("x.v", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("SELECT vec_id, list_min(embedding) >= -1 AND list_max(embedding) < 1 AS ok FROM embeddings")
def code_range_check(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as frames of four codes of 256 levels: out of range where a value is outside [-1, 1)."""
    codes = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 128).cast("int"))
    frames = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice(codes, k * 4 + 1, 4))
    return table(spark, sf, "embeddings").select("vec_id", A.codes_in_range(frames, [256] * 4).alias("ok"))


@query("SELECT doc_id AS sample_index, ['Ryan', 'Vivian', 'Ada'][doc_id % 3 + 1] AS speaker_id FROM documents")
def speaker_cycle(spark: SparkSession, sf: str) -> DataFrame:
    return speakers.assign_speakers(texts(spark, sf), VOICES).select("sample_index", "speaker_id")


_CELLS = "cells AS (SELECT doc_id AS source_index, s.k AS k, doc_id * 3 + s.k AS sample_index, s.n AS speaker_id, length(text) % 7 + s.k AS size FROM documents, (VALUES (0, 'Ryan'), (1, 'Vivian'), (2, 'Ada')) s(k, n))"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = speakers.cross_speakers(table(spark, sf, "documents").select(F.col("doc_id").alias("sample_index"), "text"), VOICES)
    size = F.length("text") % 7 + F.col("sample_index") % 3
    return cells.withColumn("codes", F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1)).cast("int")), lambda i: F.array(i)))


@query(f"WITH {_CELLS} SELECT sample_index, source_index, speaker_id FROM cells")
def speaker_cartesian(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).select("sample_index", "source_index", "speaker_id")


@query(f"WITH {_CELLS} SELECT source_index, string_agg(speaker_id, ',' ORDER BY sample_index) AS speakers, string_agg(greatest(size, 1)::VARCHAR, ',' ORDER BY sample_index) AS lengths FROM cells GROUP BY source_index")
def speaker_groups(spark: SparkSession, sf: str) -> DataFrame:
    out = speakers.group_speakers(_cells(spark, sf), 3, "codes")
    return out.select("source_index", F.array_join("speakers", ",").alias("speakers"), F.array_join(F.transform("lengths", lambda x: x.cast("string")), ",").alias("lengths"))


@query(f"WITH {_CELLS} SELECT source_index, role, speaker_id, greatest(size, 1) AS frames FROM cells, (VALUES ('source'), ('target')) r(role) WHERE role = 'target' AND speaker_id IN ('Ada', 'Ryan')")
def grid_select(spark: SparkSession, sf: str) -> DataFrame:
    cells = _cells(spark, sf).withColumn("role", F.explode(F.array(F.lit("source"), F.lit("target"))))
    grid = speakers.grid_axes(cells, ("source", "target"))
    picked = speakers.grid_select(grid, roles=["target"], speakers=["Ada", "Ryan"])
    return picked.select("source_index", "role", "speaker_id", F.size("codes").cast("long").alias("frames"))


@query(r"""WITH e AS (SELECT vec_id, embedding, text FROM embeddings JOIN documents ON vec_id = doc_id),
    m AS (SELECT vec_id, len(embedding) / 16.0 AS seconds, list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE AS peak, greatest(len(regexp_extract_all(text, '[\p{L}\p{N}]+')), 1)::DOUBLE AS units FROM e)
    SELECT vec_id, round(seconds, 9) AS duration_seconds, round(peak, 9) AS peak_amplitude, units AS text_units, CASE WHEN seconds / units > 4 OR peak < 0.05 THEN 'reject' ELSE 'accept' END AS label FROM m""")
def speech_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as one second of 16 samples each, spoken by the documents' texts."""
    rows = table(spark, sf, "embeddings").join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").withColumn("sample_index", F.col("vec_id")).withColumn("wave", F.array("embedding"))
    s = samples(rows, [("default_audio", Item({"waveform": "wave"}, sampling_rate=16)), ("default_text", Item({"text": "text"}))])
    q = quality.SpeechQuality()(s).select(F.col("sample_index").alias("vec_id"), "speech_quality.*")
    return q.select("vec_id", F.round("metrics.duration_seconds", 9).alias("duration_seconds"), F.round("metrics.peak_amplitude", 9).alias("peak_amplitude"), F.col("metrics.text_units").alias("text_units"), "label")


@query("SELECT doc_id AS sample_index, lpad(doc_id::VARCHAR, 12, '0') || '-doc' AS sample_id, text, lang FROM documents")
def store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "store")
    store.write(texts(spark, sf), root, "documents")
    store.check_integrity(spark, root, "full")
    back = store.read(spark, root, {"default_text": ["text"]})
    return back.select("sample_index", "sample_id", F.col("default_text.views.text").alias("text"), F.col("default_text.meta.lang").alias("lang"))


@query("SELECT d.doc_id AS sample_index, 'missing view' AS problem FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def store_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return store.coverage(texts(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").alias("sample_index")))


@query("SELECT d.doc_id AS sample_index, text, lang, quality::VARCHAR AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def sample_combine(spark: SparkSession, sf: str) -> DataFrame:
    labels = samples(table(spark, sf, "labels").withColumn("sample_index", F.col("doc_id")).withColumn("label", F.col("quality").cast("string")), [("default_image", Item({}, {"label": "label"}))])
    out = universe.combine(texts(spark, sf).drop("sample_id"), labels)
    return out.select("sample_index", F.col("default_text.views.text").alias("text"), F.col("default_text.meta.lang").alias("lang"), F.col("default_image.meta.label").alias("label"))


@query("SELECT doc_id AS sample_index, list_filter(string_split(text, ' '), lambda x: x <> '')[1] AS first_word, length(text) AS n FROM documents")
def materialized_view(spark: SparkSession, sf: str) -> DataFrame:
    """A text provider's new view, next to what is kept; a text of nothing but spaces has no first word."""

    def factory():
        return lambda batch: [[x.lstrip(" ").split(" ", 1)[0] or None, str(len(x))] for x in batch["c0"]]

    out = materialize.ViewMaterializer("speakers", factory, ("text",), modality="text")(texts(spark, sf))
    made = F.col("default_text.views.speakers")
    return out.select("sample_index", made[0].alias("first_word"), made[1].cast("long").alias("n"))


@query(f"WITH {_PAIRS} SELECT sample_index, length(s) AS source_samples, length(t) AS target_samples FROM a")
def modality_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Audio made of each role's text, one sample a character."""

    def factory():
        return lambda batch: [{"data": [[0.5] * len(x)], "sample_rate": 16} for x in batch["c0"]]

    out = materialize.ModalityMaterializer("audio", "waveform", factory, "text", ("source", "target"))(pairs(spark, sf))
    size = lambda r: F.size(F.col(f"{r}_audio.views.waveform.data")[0]).cast("long")
    return out.select("sample_index", size("source").alias("source_samples"), size("target").alias("target_samples"))


@query("SELECT event_id AS sample_index, value * 2 AS doubled FROM events")
def snapshot_segments(spark: SparkSession, sf: str) -> DataFrame:
    """All events derived in bounded runs, each published as a segment."""
    rows = table(spark, sf, "events").withColumnRenamed("event_id", "sample_index").select("sample_index", "value")
    catalog, n = Catalog(scratch(spark, "snapshots")), rows.count()
    while not catalog.sealed:
        catalog.produce(rows, lambda d: d.select("sample_index", (F.col("value") * 2).alias("doubled")), max_new_samples=-(-n // 3), total=n)
    return catalog.read(spark)


@query("SELECT event_id AS sample_index, value * 3 AS tripled FROM events")
def bounded_writes(spark: SparkSession, sf: str) -> DataFrame:
    """All events derived by two limited runs and one that finalizes."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("sample_index"), "value")
    path, n = scratch(spark, "bounded"), rows.count()
    make = lambda d: d.select("sample_index", (F.col("value") * 3).alias("tripled"))
    materialize.write_bounded(rows, make, path, max_new_samples=n // 2, finalize=False)
    materialize.write_bounded(rows, make, path, sample_indexes=[n - 1, n - 2], finalize=False)
    materialize.write_bounded(rows, make, path)
    return spark.read.parquet(path)


@query("SELECT coalesce(min(event_id), (SELECT count(*) FROM events)) AS prefix FROM events WHERE event_type = 'purchase'")
def completed_prefix(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "events").where("event_type <> 'purchase'").withColumnRenamed("event_id", "sample_index")
    return spark.createDataFrame([(materialize.completed_prefix(done),)], "prefix long")


def _growth(spark: SparkSession, sf: str, languages: tuple[str, ...] = LANGS) -> tuple[synthesis.Config, dict[str, int]]:
    counts = {r["lang"]: r["count"] for r in table(spark, sf, "documents").groupBy("lang").count().collect()}
    config = synthesis.Config(languages, tuple(synthesis.Slot(f"{x}-docs", x) for x in languages), VOICES, initial_sources=60, interval_sources=25)
    return config, {f"{x}-docs": counts.get(x, 0) for x in languages}


def _adm(limit: int | None = None, langs: tuple[str, ...] = LANGS) -> str:
    rows = " UNION ALL ".join(f"SELECT '{x}-docs' AS slot, '{x}' AS language, {k} AS place, unnest(range((SELECT count(*) FROM documents WHERE lang = '{x}'))) AS row" for k, x in enumerate(langs))
    return f"""fam AS (SELECT slot, language, row, row_number() OVER (ORDER BY row, place) - 1 AS sequence,
        ['Ryan', 'Vivian', 'Ada'][((('0x' || substr(sha256('7:0:' || slot || ':' || row), 1, 16))::UBIGINT) % 3)::INT + 1] AS speaker_id FROM ({rows}) {f"QUALIFY row_number() OVER (ORDER BY row, place) <= {limit}" if limit else ""}),
    tgt AS (SELECT * FROM (VALUES {', '.join(f"('{x}', {k})" for k, x in enumerate(langs))}) t(target_language, k)),
    pr AS (SELECT slot || ':' || row || '->' || target_language AS pair_id, slot AS source_slot, row AS source_row, sequence AS source_sequence, language AS source_language, target_language, speaker_id,
        row_number() OVER (PARTITION BY sequence ORDER BY k) = 1 AS first_for_source FROM fam, tgt WHERE target_language <> language)"""


@query(f"WITH {_adm(60)} SELECT slot, row, sequence, language, speaker_id FROM fam")
def growth_initial(spark: SparkSession, sf: str) -> DataFrame:
    """The first plan's families (its limit of sources is the feature)."""
    config, lengths = _growth(spark, sf)
    return synthesis.plan_growth(config, lengths, spark).families


@query(f"""WITH {_adm(60, LANGS[:3])} SELECT slot, row, 'es' AS target_language, sequence AS source_sequence, false AS first_for_source FROM fam WHERE sequence < 25""")
def growth_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """A language is declared: the pairs with it that are made up for first."""
    config, lengths = _growth(spark, sf, LANGS[:3])
    state = synthesis.plan_growth(config, lengths, spark).state
    wider, more = _growth(spark, sf, LANGS)
    grown = synthesis.plan_growth(wider, more, spark, state)
    assert grown.phase == "language_backfill"
    return grown.pairs


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Pair records of every document: the first plan takes all sources, so growth is idle after it."""
    config, lengths = _growth(spark, sf)
    config = dataclasses.replace(config, initial_sources=max(1, sum(lengths.values())))
    grown = synthesis.plan_growth(config, lengths, spark)
    return synthesis.pair_records(grown.families, grown.pairs)


@query(f"WITH {_adm()} SELECT * FROM pr")
def pair_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Pair records published and read again."""
    catalog = synthesis.PairCatalog(scratch(spark, "pairs"))
    catalog.publish(_records(spark, sf), "r1", None)
    catalog.seal()
    return catalog.read(spark)


@query(f"WITH {_adm()}, told AS (SELECT source_sequence, string_agg(target_language, ',' ORDER BY k) AS targets FROM pr JOIN tgt USING (target_language) GROUP BY source_sequence) SELECT source_sequence, source_slot, source_row, source_language, speaker_id, targets, target_language AS first_target FROM pr JOIN told USING (source_sequence) WHERE first_for_source")
def pair_summary(spark: SparkSession, sf: str) -> DataFrame:
    return synthesis.summarize(_records(spark, sf), LANGS).withColumn("targets", F.array_join("targets", ","))


@query(f"WITH {_adm()} SELECT DISTINCT source_slot, source_row, source_sequence, source_language, speaker_id FROM pr WHERE target_language IN ('en', 'de')")
def pair_sources(spark: SparkSession, sf: str) -> DataFrame:
    return synthesis.view(_records(spark, sf), "sources", target_languages=["en", "de"])


@query(f"WITH {_adm()} SELECT source_language, target_language, count(*) AS pairs, count(DISTINCT source_sequence) AS sources FROM pr GROUP BY ALL")
def catalog_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return synthesis.coverage(_records(spark, sf))


@query("SELECT doc_id, lang FROM documents")
def lang_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Codes in odd spellings come back as they were."""
    odd = F.concat(F.lit(" "), F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, "_XX").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", S.remap_lang(odd).alias("lang"))


_RESAMPLED = """WITH w AS (SELECT vec_id, list_transform(range(1, 33), lambda i: ((embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE) / 2)::FLOAT) AS v FROM embeddings),
    t AS (SELECT vec_id, v, rate, m, unnest(range(m)) AS i FROM w, (VALUES (12, 24), (16, 32), (24, 48), (11, 22)) r(rate, m)),
    p AS (SELECT *, least(i::DOUBLE * 16 / rate, 31.0::DOUBLE) AS x FROM t),
    q AS (SELECT *, floor(x)::INT AS lo, least(floor(x)::INT + 1, 31) AS hi, x - floor(x) AS part FROM p)
    SELECT vec_id, rate, i AS position, round((v[lo + 1]::DOUBLE * (1 - part) + v[hi + 1]::DOUBLE * part)::FLOAT::DOUBLE, 6) AS value FROM q"""


@query(_RESAMPLED)
def mono_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as two channels of 32 samples at rate 16: their mean, at lower, the same and higher rates, every sample of it."""
    wave = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    rows = table(spark, sf, "embeddings").select("vec_id", A.mono(wave).alias("m"), F.explode(F.array(*(F.lit(r).cast("long") for r in (11, 12, 16, 24)))).alias("rate"))
    each = rows.select("vec_id", "rate", F.posexplode(A.resample(F.col("m"), F.lit(16), F.col("rate"))).alias("position", "value"))
    return each.select("vec_id", "rate", F.col("position").cast("long").alias("position"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query('SELECT l_orderkey, l_linenumber, l_orderkey // 4096 AS "group" FROM lineitem')
def shuffled_groups(spark: SparkSession, sf: str) -> DataFrame:
    """All lineitem rows in a seeded order of groups and of rows in them (SQL knows the rows, tests know the order)."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").withColumn("group", F.floor(F.col("l_orderkey") / 4096))
    return rows.orderBy(*shards.shuffle_order(rows, 7, 0, "group", "l_orderkey"), "l_linenumber")


@query(r"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), t AS (SELECT doc_id, len(list_distinct(w))::DOUBLE / greatest(len(w), 1) AS score FROM s)
    SELECT doc_id AS sample_index, CASE WHEN score >= 0.6 THEN 'accept' ELSE 'reject' END AS label, round(score, 9) AS score FROM t""")
def model_score(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer UDF over all documents (toy model: share of distinct words)."""

    def factory():
        return lambda b: [len(set(x.split())) / max(1, len(x.split())) for x in b["c0"]]

    out = quality.ModelScore(factory, ("default_text.views.text",))(texts(spark, sf))
    return out.select("sample_index", "model_score.label", F.round("model_score.score", 9).alias("score"))

