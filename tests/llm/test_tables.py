"""URL filter, chat formatting, WARC assembly."""

import random

from pyspark.sql import functions as F

from tessella.llm import chat, url_filter, warc


def test_canonical_forms(spark):
    cases = {
        "HTTP://WWW.Example.com:80/a/b.html?utm_source=x&b=2&a=1#top": "example.com/a/b.html?a=1&b=2",
        "https://m.example.com/a/b/": "m.example.com/a/b",
        "http://example.com/x.html": "example.com/x.html",
        "http://example.com/x": "example.com/x",
        "http://www.example.com/x/index.htm#a": "example.com/x",
        "example.com/index.html": "example.com",
        "//user@example.com:443/?ref=y": "example.com",
        "https://blog.example.com:8080/A?q=%20": "blog.example.com:8080/A?q=%20",
        "": None,
        "   ": None,
        "https:///path": None,
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "url string").select("url", url_filter.canonical(F.col("url")).alias("c")).collect()
    assert {r["url"]: r["c"] for r in rows} == cases


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    rng = random.Random(4)
    urls = [f"http://h{rng.randrange(50)}.example.com/{i}" for i in range(6000)]
    listed = spark.createDataFrame([(u,) for u in urls[:1000]] * 2, "url string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("listed", F.lit("old")).withColumn("block", F.lit(1))
    for f in (url_filter.Filter(), url_filter.Filter(bits_per_url=40)):
        out = url_filter.mark(pages, listed, f)
        assert out.columns == ["page_id", "url", "block", "canonical_url", "possible", "listed"]
        rows = out.collect()
        assert len(rows) == 6000 and {r["page_id"] for r in rows if r["listed"]} == set(range(1000))
        assert all(r["possible"] for r in rows if r["listed"])
        assert sum(r["possible"] for r in rows) < 1000 + 0.03 * 5000


def test_filter_of_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", 1), (2, "http://b.com/", 2)], "page_id long, url string, n long").selectExpr("*", *(f"'{c}' as `{c}`" for c in ("__block", "__w0", "__url", "block", "w0", "key", "__key", "_hash", "possible")))
    out = url_filter.mark(pages, spark.createDataFrame([("https://www.a.com/x/", 5)], "url string, canonical_url long"))
    assert out.columns == [*(c for c in pages.columns if c != "possible"), "canonical_url", "possible", "listed"]
    assert sorted((r["page_id"], r["__block"], r["__url"], r["listed"]) for r in out.collect()) == [(1, "__block", "__url", True), (2, "__block", "__url", False)]


def test_filter_odd_rows(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "http://a.com"), (3, "http://a.com"), (None, "a.com/" + "x" * 20000)], "page_id long, url string")
    listed = spark.createDataFrame([("https://www.a.com/",), (None,), ("",)], "url string")
    rows = url_filter.mark(pages, listed).collect()
    assert sorted((r["page_id"] or 0, r["listed"]) for r in rows) == [(0, False), (1, False), (2, False), (3, True), (3, True)]
    assert [r["listed"] for r in url_filter.mark(pages, listed.limit(0)).collect()] == [False] * 5
    assert url_filter.mark(pages.limit(0), listed).collect() == []


def test_every_reply_is_an_example(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "more"), (1, 4, "assistant", "yes"), (2, 0, "assistant", "first"), (3, 0, "user", "alone")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r["conv_id"], r["turn"]): r for r in chat.examples(rows).collect()}
    assert set(got) == {(1, 2), (1, 4), (2, 0)}
    last = got[1, 4]
    assert last["context"] == "".join(f"<|{r}|>\n{t}<|end|>\n" for _, _, r, t in turns[:4]) and last["n_context"] == 4
    for r in got.values():
        assert r["text"][: r["train_start"]] == r["context"] + "<|assistant|>\n"
        assert r["text"][r["train_start"] : r["train_end"]] == r["reply"] + chat.END and r["train_end"] == len(r["text"])


def test_chat_odd_rows(spark):
    long = "word " * 30000
    turns = [(1, None, "user", "no number"), (1, 0, None, "no role"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, 2, "assistant", long), (None, 0, "assistant", "lost"), (2, 0, "assistant", "")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as said", "3 as reply")
    got = sorted((r["conv_id"], r["turn"], r["position"], r["reply"]) for r in chat.examples(rows).collect())
    assert got == [(1, 1, 2, ""), (1, 1, 3, ""), (1, 2, 4, long), (2, 0, 0, "")]
    first = [r for r in chat.examples(rows).collect() if r["position"] == 2][0]
    assert first["context"] == "<|user|>\nno number<|end|>\n<|unknown|>\nno role<|end|>\n"
    assert chat.examples(rows.limit(0)).collect() == []


RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, date string, headers map<string,string>, block string"


def test_transactions_in_either_direction(spark):
    rows = [
        ("q1", "request", ["r1"], "u1", "d", {}, "GET"), ("r1", "response", None, "u1", "d", {"a": "b"}, "body"), ("m1", "metadata", ["q1"], "u1", "d", {}, "meta"),
        ("r2", "response", ["q2", "m2"], "u2", "d", {}, None), ("q2", "request", [], "u2", "d", {}, ""), ("m2", "metadata", None, "u2", "d", {}, "x"),
        ("q3", "request", ["gone"], "u3", "d", {}, "lost"), ("m3", "metadata", ["gone"], "u3", "d", {}, "too"), ("m4", "metadata", ["m1"], "u1", "d", {}, "far"),
    ]
    out = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows, RECORD).repartition(4)).collect()}
    assert set(out) == {"r1", "r2", "gone"}
    assert [m["record_id"] for m in out["r1"]["metadata"]] == ["m1", "m4"] and out["r1"]["requests"][0]["block"] == "GET" and out["r1"]["response"]["block"] == "body"
    assert out["r2"]["response"]["block"] is None and [q["record_id"] for q in out["r2"]["requests"]] == ["q2"]
    assert out["gone"]["response"] is None and out["gone"]["target_uri"] == "u3" and len(out["gone"]["metadata"]) == 1


def test_links_are_followed_over_any_number_of_steps(spark):
    chain = [("r", "response", None)] + [(f"m{k:02}", "metadata", [f"m{k - 1:02}" if k else "r"]) for k in range(30)]
    lost = [("x1", "request", ["gone"]), ("x2", "metadata", ["x1"]), ("x3", "metadata", ["x2", None, "x3"]), ("x4", "metadata", ["x3"])]
    # y2 and z2 hang together beyond their captures, and go to the smaller; y1 and z1 stay with what they name
    both = [("ra", "response", None), ("rb", "response", None), ("y1", "request", ["rb"]), ("z1", "request", ["ra"]), ("y2", "metadata", ["y1"]), ("z2", "metadata", ["z1", "y2"])]
    through = [("rc", "response", ["hole"]), ("w1", "metadata", ["hole"])]  # both name a record that is not there
    rows = [(i, t, c, "u", "d", {}, "b") for i, t, c in chain + lost + both + through + [("alone", "warcinfo", None)]]
    out = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows, RECORD).repartition(5)).collect()}
    assert set(out) == {"r", "gone", "ra", "rb", "rc", "alone"}
    ids = lambda c, k: [x["record_id"] for x in out[c][k]]
    assert ids("r", "metadata") == [f"m{k:02}" for k in range(30)]
    assert ids("gone", "requests") == ["x1"] and ids("gone", "metadata") == ["x2", "x3", "x4"] and out["gone"]["response"] is None
    assert ids("ra", "requests") == ["z1"] and ids("ra", "metadata") == ["y2", "z2"] and ids("rb", "requests") == ["y1"] and ids("rb", "metadata") == []
    assert ids("rc", "metadata") == ["w1"] and ids("alone", "metadata") == ["alone"]


def test_no_record_type_is_dropped(spark):
    rows = [("v", "revisit", None), ("q", "request", ["v"]), ("s", "resource", None), ("m", "metadata", ["s"]), ("c", "conversion", None), ("i", "warcinfo", ["c"]), ("n", "something", ["q"])]
    out = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame([(i, t, c, "u", "d", {"warc-type": t}, "b") for i, t, c in rows], RECORD)).collect()}
    assert set(out) == {"v", "s", "c"} and [r["record_id"] for r in out["v"]["requests"]] == ["q"] and [r["record_id"] for r in out["v"]["metadata"]] == ["n"]
    assert [h["v"] for h in out["v"]["response"]["headers"]] == ["revisit"] and [r["record_id"] for r in out["c"]["metadata"]] == ["i"]


def test_records_survive_parsing(spark):
    raw = "WARC/1.0\r\nWARC-Type: Response\r\nWARC-Record-ID: <urn:1>\r\nX-Long: one\r\n two\r\nWARC-Concurrent-To: <urn:2>\r\nWARC-Concurrent-To: <urn:3>\r\n\r\nbody\r\n\r\nmore"
    rows = spark.createDataFrame([(raw,), (None,), ("",), ("no record",)], "record string")
    (r,) = warc.parse(rows).collect()
    assert (r["record_id"], r["type"], r["concurrent_to"], r["block"], r["headers"]["x-long"]) == ("urn:1", "response", ["urn:2", "urn:3"], "body\r\n\r\nmore", "one two")


def test_warc_odd_rows(spark):
    rows = [("r", "response", None, "u", "d", None, "x" * 100_000), ("r", "response", None, "u", "d", None, "x" * 100_000), (None, "request", ["r"], "u", "d", {}, ""), ("q", None, ["r"], "u", "d", {}, ""), ("z", "request", ["z", None], None, None, {}, "")]
    records = spark.createDataFrame(rows, RECORD).selectExpr("*", "1 as part", "2 as capture_id", "3 as capture", "4 as kind", "5 as requests", "6 as a", "7 as root")
    out = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert set(out) == {"r", "z"} and len(out["r"]["response"]["block"]) == 100_000 and out["r"]["requests"] == []
    assert warc.assemble(records.limit(0)).collect() == []


def test_every_page_is_a_capture(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = warc.assemble(warc.parse(warc.records_of_pages(pages))).collect()
    assert len(rows) == pages.count() and all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in rows)
    html = {r["url"]: r["html"] for r in pages.collect()}
    assert all(r["response"]["block"].endswith(html[r["target_uri"]]) for r in rows)
