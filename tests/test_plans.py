"""Sources, row maps, store, materialization, snapshots, synthesis, and the driver entry."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella import rowmap, schema, sources
from tessella.operators import universe as U
from tessella.plans import files, materialize, store, synthesis
from tessella.rowmap import Item
from tessella.sources import delimited, presets
from tessella.sources import files as listing
from tessella.spec import Spec, resolve
from tessella.streaming import snapshots


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_specs():
    a = Spec.of("tsv", "/data", "train", num_proc=4)
    assert a.id == Spec.of("tsv", "/data", "train").id != Spec.of("tsv", "/data", "test").id and len(a.id) == 16
    assert resolve("tsv://C:\\data\\x:train") == Spec.of("tsv", "C:\\data\\x", "train") and resolve("tsv:///a/b") == Spec.of("tsv", "/a/b")
    assert resolve("files://a[1:2]:dev").path == "a[1:2]" and resolve("wmt:test", {"wmt": a}).split == "test"
    with pytest.raises(KeyError):
        resolve("nothing")


def test_tsv(spark, tmp_path):
    write(tmp_path / "b" / "train.tsv", 'path\tsentence\n1.mp3\t"two\nlines"\n2.mp3\t\n')
    write(tmp_path / "a" / "train.tsv", "path\tsentence\n3.mp3\tlast\n")
    spec = Spec.of("tsv", str(tmp_path), "train", subdirs=["b", "a"], root_field="root")
    rows = sources.read(spark, spec).orderBy("sample_index").collect()
    assert [(r["sample_index"], r["path"], r["sentence"]) for r in rows] == [(0, "1.mp3", "two\nlines"), (1, "2.mp3", ""), (2, "3.mp3", "last")]
    assert rows[2]["root"].endswith("/a")
    one = sources.read(spark, Spec.of("tsv", str(tmp_path / "a" / "train.tsv")))
    assert one.count() == 1
    for bad in (Spec.of("tsv", str(tmp_path)), Spec.of("tsv", str(tmp_path), "test")):
        with pytest.raises((ValueError, FileNotFoundError)):
            sources.read(spark, bad)
    with pytest.raises(TypeError):
        sources.read(spark, Spec.of("tsv", str(tmp_path), "train", colour="red"))
    with pytest.raises(KeyError):
        sources.read(spark, Spec.of("nothing", "x"))
    write(tmp_path / "bad.tsv", "a\ta\n1\t2\n")
    with pytest.raises(ValueError):
        sources.read(spark, Spec.of("tsv", str(tmp_path / "bad.tsv")))


def test_sharded_csv_in_numeric_order(spark, tmp_path):
    for shard, name, text in ((0, "10", "ten"), (0, "2", "two"), (10, "0", "last"), (2, "0", "middle")):
        write(tmp_path / f"shard_{shard}" / f"{name}.csv", f"src_text,n\n{text},007\n")
    write(tmp_path / "shard_x" / "0.csv", "ignored\n1\n")
    rows = sources.read(spark, Spec.of("sharded_csv", str(tmp_path))).orderBy("sample_index").collect()
    assert [(r["src_text"], r["n"]) for r in rows] == [("two", "007"), ("ten", "007"), ("middle", "007"), ("last", "007")]
    assert delimited.missing_shards([0, 2, 10]) == [(1, 1), (3, 9)]
    write(tmp_path / "shard_0" / "02.csv", "src_text,n\nx,1\n")
    with pytest.raises(ValueError):
        delimited.shard_files(str(tmp_path))


def test_prepare_reads_only_what_changed(spark, tmp_path):
    a, b, home = tmp_path / "a.csv", tmp_path / "b.csv", str(tmp_path / "out")
    write(a, "x\n1\n2\n")
    write(b, "x\n3\n")
    assert delimited.prepare(spark, [str(a), str(b)], home) == [str(a), str(b)]
    assert delimited.prepare(spark, [str(a), str(b)], home) == []
    write(b, "x\n4\n5\n")
    assert delimited.prepare(spark, [str(a), str(b)], home) == [str(b)]
    assert [r["x"] for r in delimited.prepared(spark, home).orderBy("sample_index").collect()] == ["1", "2", "4", "5"]


def test_file_listings(spark, tmp_path):
    for name in ("d/2.wav", "d/1.wav", "d/x.txt"):
        write(tmp_path / name, name)
    rows = sources.read(spark, Spec.of("files", str(tmp_path), prefix="d/", suffixes=(".wav",))).collect()
    assert [(r["sample_index"], r["path"]) for r in rows] == [(0, "d/1.wav"), (1, "d/2.wav")] and os.path.exists(rows[0]["local_path"])
    full = sources.read(spark, Spec.of("files", str(tmp_path), suffixes=(".wav",), bytes=True)).orderBy("sample_index").collect()
    assert [bytes(r["content"]) for r in full] == [b"d/1.wav", b"d/2.wav"]
    with pytest.raises(FileNotFoundError):
        sources.read(spark, Spec.of("files", str(tmp_path), prefix="none"))
    assert listing.listing([("p1", (["a"], "p2")), ("p2", (["b"], None))]) == ["a", "b"]
    for bad in ([("p1", (["a"], "p1")), ("p1", (["a"], None))], [("p1", (["a"], "p2"))]):
        with pytest.raises(RuntimeError):
            listing.listing(bad)


def test_tables_and_presets(spark, tmp_path):
    spark.createDataFrame([({"cs": "ahoj", "en": "hi"},)], "translation map<string,string>").write.parquet(str(tmp_path / "wmt" / "train"))
    r = presets.PRESETS["wmt19"].load(spark, str(tmp_path / "wmt")).first()
    assert r["source_text"]["views"]["text"] == "ahoj" and r["target_text"]["meta"]["lang"] == "en" and r["sample_index"] == 0
    with pytest.raises(ValueError):
        presets.PRESETS["wmt19"].load(spark, str(tmp_path / "wmt"), source_lang="en", target_lang="en")
    spark.createDataFrame([((([0.5, 0.25]), 8), "dog", 3, True)], "audio struct<array:array<float>,sampling_rate:int>, category string, target int, esc10 boolean").select(F.struct(F.array("audio.array").alias("array"), "audio.sampling_rate").alias("audio"), "category", "target", "esc10").write.parquet(str(tmp_path / "esc" / "train"))
    r = presets.PRESETS["esc50"].load(spark, str(tmp_path / "esc")).first()["default_audio"]
    assert r["views"]["waveform"]["sample_rate"] == 8 and r["meta"]["label"] == "dog" and r["meta"]["labels"] == {"target": "3", "esc10": "true"}
    write(tmp_path / "cv" / "train.tsv", "client_id\tpath\tsentence\tlocale\nc1\ta.mp3\thello\ten\nc2\tb.mp3\tbonjour\tfr\n")
    r = presets.PRESETS["common_voice"].load(spark, str(tmp_path / "cv"), languages=["fr"]).collect()
    assert len(r) == 1 and r[0]["default_text"]["meta"]["lang"] == "fr" and r[0]["default_audio"]["meta"]["speaker_id"] == "c2"
    for bad in ({"streaming": True}, {"config_name": "a", "name": "b"}):
        with pytest.raises(ValueError):
            sources.read(spark, Spec.of("table", str(tmp_path / "wmt"), "train", **bad))
    assert set(presets.PRESETS) >= {"mnist", "cifar10", "fsd50k", "fleurs", "librispeech_asr", "nsynth"}


def test_row_maps(spark):
    rows = spark.createDataFrame([(0, {"a": "x"}, "EN_us")], "sample_index long, m map<string,string>, lang string")
    r = rowmap.samples(rows, [("default_text", Item({"text": ("m", "a")}, {"lang": "lang"}, {"source_index": 5}))]).first()["default_text"].asDict(True)
    assert r == {"views": {"text": "x"}, "meta": {"lang": "en", "source_index": 5}}
    for bad in ([("default_text", Item({"pixel": "m"}))], [("default_text", Item())] * 2, [("default_audio", Item({"waveform": "m"}))], [("default_text", Item({"text": "lang"}, {"lang": "lang"}, {"lang": "en"}))]):
        with pytest.raises(ValueError):
            rowmap.samples(rows, bad)


@pytest.fixture
def two(spark):
    rows = spark.createDataFrame([(i, f"{i:012d}-s", f"t{i}") for i in range(10)], "sample_index long, sample_id string, t string")
    return rowmap.samples(rows, [("default_text", Item({"text": "t"}, constants={"lang": "en"}))])


def test_store(spark, tmp_path, two):
    root = str(tmp_path / "s")
    store.write_part(two.where("sample_index < 4"), root, "a")
    store.write_part(two.where("sample_index >= 4"), root, "b")
    with pytest.raises(FileNotFoundError):
        store.read(spark, root)
    assert store.commit(spark, root, "d", expected=10) == 10
    for level in ("fast", "normal", "full"):
        assert store.check_integrity(spark, root, level) == 10
    assert store.read(spark, root, {"default_text": ["text"]}).where("sample_index = 7").first()["default_text"]["views"]["text"] == "t7"
    for views, error in (({"default_text": ["nope"]}, KeyError), ({"x_text": []}, KeyError), ({"default_text": ["text", "text"]}, ValueError)):
        with pytest.raises(error):
            store.read(spark, root, views)
    with pytest.raises(FileExistsError):
        store.write(two, root, "d")
    assert sources.read(spark, Spec.of("store", root)).count() == 10
    gap = str(tmp_path / "gap")
    store.write_part(two.where("sample_index <> 4"), gap, "a")
    with pytest.raises(ValueError):
        store.commit(spark, gap, "d")
    plan = store.read(spark, root, {"default_text": ["text"]}).select("default_text.meta.lang")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<default_text:struct<meta:struct<lang:string>>>" in plan


def test_migration(spark, tmp_path):
    root = tmp_path / "old"
    spark.createDataFrame([(0, "a", "x")], "sample_index long, sample_id string, default_text string").write.parquet(str(root / "rows"))
    files.write_json(root / "dataset.json", {"version": 1, "dataset_id": "d", "split": None, "samples": "rows", "count": 1, "start": 0})
    (root / ".ready").touch()
    with pytest.raises(ValueError):
        store.read(spark, str(root))
    store.migrate(spark, str(root))
    assert store.read(spark, str(root)).first()["default_text"]["views"]["text"] == "x" and store.check_integrity(spark, str(root), "full") == 1


def test_coverage(spark, two):
    rows = spark.createDataFrame([(i,) for i in (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 12)], "sample_index long")
    assert sorted(map(tuple, store.coverage(two, rows).collect())) == [(0, "repeated view"), (9, "missing view"), (12, "unknown sample")]


def test_materializers(spark, two):
    keep = schema.Schema({"default_text": schema.Requirement(("text",), ("lang",))})
    sizes = []

    def factory():
        return lambda b: [[x, x.upper()] for x in b["c0"]]

    out = materialize.ViewMaterializer("speakers", factory, ("text",), "text", keep=keep)(two)
    assert out.where("sample_index = 1").first()["default_text"].asDict(True) == {"views": {"speakers": ["t1", "T1"], "text": "t1"}, "meta": {"lang": "en"}}
    with pytest.raises(ValueError):
        materialize.ModalityMaterializer("text", "text", factory, "text")(two)
    with pytest.raises(KeyError):
        materialize.ViewMaterializer("waveform", factory, ("file",))(two)
    whole = materialize.SampleMaterializer(lambda: lambda b: pd.DataFrame({"sample_index": b["sample_index"], "n": 1}), "sample_index long, n int")
    assert whole(two).count() == 10
    with pytest.raises(Exception, match="outputs for"):
        materialize.ViewMaterializer("speakers", lambda: lambda b: [], ("text",), "text")(two).collect()

    def small(batch):
        sizes.append(len(batch))
        if len(batch) > 3:
            raise MemoryError
        return list(batch["x"])

    assert materialize.call_split(small, pd.DataFrame({"x": range(10)})) == list(range(10)) and max(sizes) == 10


def test_prefix_and_bounds(spark, two):
    assert materialize.completed_prefix(two) == 10 and materialize.completed_prefix(two.where("sample_index <> 6")) == 6
    assert materialize.completed_prefix(two.where("sample_index > 0")) == 0 and materialize.completed_prefix(two.limit(0)) == 0
    assert [r[0] for r in materialize.bounded(two, two.where("sample_index < 3"), 2).select("sample_index").collect()] == [3, 4]


def test_snapshots(spark, tmp_path, two):
    c = snapshots.Catalog(str(tmp_path / "c"))
    with pytest.raises(LookupError):
        c.read(spark)
    assert c.produce(two, lambda d: d, 4, total=10) == 4
    early = c.read(spark)
    assert c.produce(two, lambda d: d, 100, total=10) == 10 and c.sealed and early.count() == 4 and c.read(spark).count() == 10 and c.read(spark, 5).count() == 5
    with pytest.raises(ValueError):
        c.append(two)
    d = snapshots.Catalog(str(tmp_path / "d"))
    with pytest.raises(ValueError):
        d.append(two.where("sample_index > 2"))
    assert sources.read(spark, Spec.of("snapshots", str(tmp_path / "c"))).count() == 10


def test_streams_become_segments(spark, tmp_path):
    inbox = str(tmp_path / "in")
    c = snapshots.Catalog(str(tmp_path / "c"))
    for k in range(2):
        spark.createDataFrame([(f"t{k}-{i}",) for i in range(3)], "text string").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("text string").parquet(inbox)
        snapshots.follow(stream, c, lambda d: d, str(tmp_path / "cp")).awaitTermination()
        assert c.stop == 3 * (k + 1)
    assert U.check_dense(c.read(spark)) == 6
    assert c.append(spark.createDataFrame([("x",)], "text string"), batch=c.state()["batches"][0], index=None) == 6  # a repeated batch
    live = snapshots.decide_live(spark.readStream.schema("text string").parquet(inbox), lambda d: d.select(F.length("text").cast("long").alias("sample_index"), F.lit("ok").alias("label")), str(tmp_path / "out"), str(tmp_path / "cp2"))
    live.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


LANGS = ("en", "zh")


def config(languages=LANGS, speakers=("V", "R"), **more):
    return synthesis.Config(languages, tuple(synthesis.Slot(f"{x}{k}", x) for x in languages for k in (0, 1)), speakers, initial_sources=5, interval_sources=3, **more)


def brute_admission(slots, lengths, cursors, start, limit):
    cursors, out, at, stalled = dict(cursors), [], start, 0
    while len(out) < limit and stalled < len(slots):
        name = slots[at].name
        at = (at + 1) % len(slots)
        if cursors.get(name, 0) >= lengths[name]:
            stalled += 1
            continue
        out.append((name, cursors.get(name, 0)))
        cursors[name] = cursors.get(name, 0) + 1
        stalled = 0
    return out, at


def test_growth(spark):
    c, lengths = config(), {"en0": 4, "en1": 1, "zh0": 2, "zh1": 3}
    g = synthesis.plan_growth(c, lengths, spark)
    want, at = brute_admission(c.ordered_slots, lengths, {}, 0, 5)
    assert g.phase == "initial" and [(r["slot"], r["row"]) for r in g.families.orderBy("sequence").collect()] == want and g.state.next_slot == at
    assert g.pairs.count() == 5 and g.pairs.where("first_for_source").count() == 5
    h = synthesis.plan_growth(c, lengths, spark, g.state)
    more, _ = brute_admission(c.ordered_slots, lengths, g.state.cursors, at, 3)
    assert h.phase == "vertical" and [(r["slot"], r["row"]) for r in h.families.orderBy("sequence").collect()] == more and h.families.agg(F.min("sequence")).first()[0] == 5
    wide = config(("en", "zh", "fr"))
    lengths |= {"fr0": 9, "fr1": 0}
    i = synthesis.plan_growth(wide, lengths, spark, h.state)
    assert i.phase == "language_backfill" and i.pairs.count() == 3 and not i.pairs.where("first_for_source").count() and i.state.catchup == {"fr": 4}
    while i.phase == "language_backfill":
        i = synthesis.plan_growth(wide, lengths, spark, i.state)
    assert i.phase == "language_sources" and {r["language"] for r in i.families.collect()} == {"fr"} and i.families.count() == 3
    j = synthesis.plan_growth(wide, lengths, spark, i.state)
    assert j.phase == "language_sources" and j.families.count() == 1
    end = j
    for _ in range(5):
        end = synthesis.plan_growth(wide, lengths, spark, end.state)
    assert end.phase == "idle"
    with pytest.raises(ValueError):
        synthesis.plan_growth(wide, lengths | {"en0": 0}, spark, j.state)
    for other in (config(("zh", "en")), config(seed=8), config(speakers=("R", "V"))):
        with pytest.raises(ValueError):
            synthesis.plan_growth(other, lengths, spark, g.state)
    with pytest.raises(ValueError):
        config(("en", "en"))


def test_voice_is_the_hash(spark):
    import hashlib

    rows = spark.range(50).select(F.lit("s").alias("slot"), F.col("id").alias("row"))
    for r in rows.select("row", synthesis.voice(7, 1, F.col("slot"), F.col("row"), ("a", "b", "c")).alias("v")).collect():
        assert r["v"] == "abc"[int.from_bytes(hashlib.sha256(f"7:1:s:{r['row']}".encode()).digest()[:8]) % 3]


def test_pair_catalog_and_stage(spark, tmp_path):
    c, lengths = config(), {"en0": 4, "en1": 1, "zh0": 2, "zh1": 3}
    g = synthesis.plan_growth(c, lengths, spark)
    catalog = synthesis.PairCatalog(str(tmp_path / "p"))
    one = catalog.publish(synthesis.pair_records(g.families, g.pairs), "r1", None)
    assert catalog.publish(synthesis.pair_records(g.families, g.pairs), "r1", None) == one and one["total_pairs"] == 5
    h = synthesis.plan_growth(c, lengths, spark, g.state)
    new = synthesis.pair_records(h.families, h.pairs)
    for bad in (lambda: catalog.publish(new, "r2", "r0"), lambda: catalog.publish(synthesis.pair_records(g.families, g.pairs), "r2", "r1")):
        with pytest.raises(ValueError):
            bad()
    assert catalog.publish(new, "r2", "r1")["total_pairs"] == 8 and catalog.status(10)["pending"] == 2
    stage = synthesis.Stage(str(tmp_path / "st"), catalog)
    rows, pin = stage.next_input(spark)
    stage.publish(rows, pin)
    with pytest.raises(ValueError):
        stage.publish(rows, pin)
    rows, pin = stage.next_input(spark, 5)
    stage.publish(rows, pin)
    assert stage.next_input(spark)[0] is None and stage.read(spark).count() == 8
    catalog.seal()
    with pytest.raises(ValueError):
        catalog.publish(new, "r3", "r2")
    catalog.export(spark, str(tmp_path / "json"))
    assert "pair_id" in json.loads(next((tmp_path / "json").glob("*.json")).read_text().splitlines()[0])
    s = synthesis.summarize(catalog.read(spark), LANGS).collect()
    assert len(s) == 8 and all(r["targets"] == [r["first_target"]] for r in s)
    assert synthesis.view(catalog.read(spark), "sources", slots=["en0"]).count() == catalog.locate(spark, catalog.read(spark).where("source_slot = 'en0'").select("source_slot", "source_row").distinct()).count()
    assert synthesis.coverage(catalog.read(spark)).agg(F.sum("pairs")).first()[0] == 8
    assert synthesis.toy_sources(spark, 3, LANGS).count() == 3


def test_locks(tmp_path):
    with files.lock(tmp_path / "l"):
        with pytest.raises(TimeoutError):
            with files.lock(tmp_path / "l", wait_s=0.2):
                pass
    with files.lock(tmp_path / "l"):
        pass


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bounded_writes_and_what_they_need(spark, tmp_path):
    from tessella.plans import materialize

    rows, path, make = spark.range(10).withColumnRenamed("id", "sample_index"), str(tmp_path / "out"), lambda d: d.withColumn("x", d.sample_index * 2)
    with pytest.raises(ValueError, match="finalize"):
        materialize.write_bounded(rows, make, path, max_new_samples=3)
    assert materialize.write_bounded(rows, make, path, max_new_samples=3, finalize=False) == 7
    assert materialize.write_bounded(rows, make, path, sample_indexes=[2, 9], finalize=False) == 6
    assert materialize.write_bounded(rows, make, path) == 0
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(k, 2 * k) for k in range(10)]
    with pytest.raises(ValueError, match="no result"):
        materialize.write_bounded(rows, lambda d: make(d).where("sample_index < 5"), str(tmp_path / "other"))


def test_stages_chain():
    from tessella.plans.synthesis import check_chain

    facts = {"lineage": "l", "revision": 3, "config_revision": 1, "sources": 4, "pairs": 8, "coverage": {"en->fr": 8}}
    parent = {"stage": "source", "snapshot": "s1", "digest": "d1", **facts}
    child = {"stage": "translation", "upstream_snapshot": "s1", "upstream_digest": "d1", **facts}
    check_chain(child, parent)
    for change in ({"upstream_digest": "x"}, {"stage": "speech"}, {"stage": "source"}, {"pairs": 9}, {"revision": 2}, {"coverage": {}}):
        with pytest.raises(ValueError):
            check_chain(child | change, parent)


def test_items_round_trip(spark):
    from tessella import schema as S

    rows = spark.createDataFrame([(0, ("x",), ("en",)), (1, None, None)], "sample_index long, v struct<text:string>, m struct<lang:string>").selectExpr("sample_index", "if(v is null, null, struct(v as views, m as meta)) as default_text")
    got = [r[0] for r in rows.orderBy("sample_index").select(S.items_json(rows)).collect()]
    assert got == ['[[["default","text"],{"lang":"en"}]]', "[]"] and S.parse_items(got[0]) == {"default_text": {"lang": "en"}} and S.parse_items(got[1]) == {}
    for bad in ("{}", "[1]", '[[["default"],{}]]', '[[["other","text"],{}]]', '[[["default","text"],{}],[["default","text"],{}]]', "["):
        with pytest.raises(ValueError):
            S.parse_items(bad)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    from tessella import queries

    fake = lambda master, folder: Fake(conf=Fake(get=lambda key, default=None: folder), sparkContext=Fake(master=master))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        queries.scratch(fake("yarn", None), "x")
    assert queries.scratch(fake("yarn", "file:///shared"), "x").startswith("/shared/") and queries.scratch(fake("local[2]", None), "x")


def test_voice_corpora_have_versions_and_languages(spark, tmp_path):
    from tessella.sources.presets import common_voice, corpus_root

    for corpus, langs in (("cv-corpus-9.0-2022-04-27", ("de",)), ("cv-corpus-17.0-2024-03-15", ("de", "en", "fr"))):
        for lang in langs:
            home = tmp_path / corpus / lang
            home.mkdir(parents=True)
            (home / "train.tsv").write_text(f"client_id\tpath\tsentence\tlocale\nspeaker\tclip.mp3\t{corpus[10:12]} {lang}\t{lang}\n")
    load = lambda **k: [(r["default_text"]["views"]["text"], r["default_text"]["meta"]["lang"], r["default_audio"]["views"]["file"]["data"].decode()) for r in common_voice(spark, str(tmp_path), **k).orderBy("sample_index").collect()]
    newest = load()
    assert [x[:2] for x in newest] == [("17 de", "de"), ("17 en", "en"), ("17 fr", "fr")]
    assert newest[0][2] == str(tmp_path / "cv-corpus-17.0-2024-03-15" / "de" / "clips" / "clip.mp3")
    assert [x[1] for x in load(languages=("fr", "de", "fr"))] == ["fr", "de"] and [x[0] for x in load(version="9.0")] == ["9. de"]
    assert corpus_root(str(tmp_path / "cv-corpus-9.0-2022-04-27"))[1] == "9.0"
    for bad in ({"version": "8"}, {"languages": ("es",)}, {"split": "test"}):
        with pytest.raises(FileNotFoundError):
            load(**bad)
    with pytest.raises(ValueError):
        load(split="all")


def odd_documents(spark, folder, texts):
    """A documents table of the given texts in ``folder``, which it returns."""
    rows = [(i, x, "en", "s", None if x is None else len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_documents_without_characters_get_into_batches(spark, tmp_path):
    from tessella import queries

    texts = ["word " * 8, "", "  ", "abc", None, "x" * 40]
    got = queries.QUERIES["cost_batches"](spark, odd_documents(spark, tmp_path / "odd", texts)).collect()
    assert sum(r["samples"] for r in got) == 6 and sum(r["cost"] for r in got) == 40 + 1 + 2 + 3 + 1 + 40 and max(r["cost"] for r in got) <= 40
    assert queries.QUERIES["cost_batches"](spark, odd_documents(spark, tmp_path / "none", [])).collect() == []
    assert [r["cost"] for r in queries.QUERIES["cost_batches"](spark, odd_documents(spark, tmp_path / "bare", ["", ""])).collect()] == [1, 1]


def test_texts_without_words_have_views(spark, tmp_path):
    from tessella import queries

    texts = ["", "  ", "  lead in", "\nline two", None, "one"]
    got = queries.QUERIES["materialized_view"](spark, odd_documents(spark, tmp_path, texts)).orderBy("sample_index").collect()
    assert [tuple(r) for r in got] == [(0, None, 0), (1, None, 2), (2, "lead", 9), (3, "\nline", 9), (4, None, None), (5, "one", 3)]


def test_providers_hold_one_piece_at_a_time(spark):
    rows = spark.createDataFrame([(i, None if i == 7 else "x" * (1 + i % 5) * (400_000 if i in (3, 900) else 1)) for i in range(1000)], "sample_index long, x string").coalesce(1)
    spans = []

    def factory():
        held = []  # sizes and output rows of the batches so far

        def provider(batch):
            held.append((len(batch), int(batch["c0"].str.len().sum())))
            return [{"data": [[0.5] * len(x)], "sample_rate": len(held)} for x in batch["c0"]]

        return provider

    wave = materialize.provide(factory, "struct<data:array<array<float>>,sample_rate:int>")("x")
    got = rows.select("sample_index", F.length("x").alias("n"), F.size(wave["data"][0]).alias("made"), wave["sample_rate"].alias("call")).orderBy("sample_index").collect()
    assert len(got) == 1000 and all(r["made"] == r["n"] for r in got if r["sample_index"] != 7) and got[7]["made"] is None and got[7]["call"] is None
    for call in {r["call"] for r in got} - {None}:
        own = [r["n"] for r in got if r["call"] == call]
        spans.append(len(own))
        assert len(own) <= 256 and (sum(own) <= 1 << 20 or len(own) == 1)
    assert sum(spans) == 999 and len(spans) > 4


def test_batches_are_cut_without_loss():
    import pyarrow as pa

    from tessella.functions import batches

    batch = pa.StructArray.from_arrays([pa.array(["a" * 10] * 600 + [None, "b" * 5000, "c"]), pa.array([[[1.0], [2.0, 3.0]]] * 603)], ["c0", "c1"])
    parts = list(batches.cut(batch, 256, 4000))
    assert pa.concat_arrays(parts).equals(batch) and all(len(p) <= 256 and (p.nbytes <= 4000 or len(p) == 1) for p in parts)
    frames = list(batches.pieces(iter([batch, batch.slice(0, 0), batch]), 256, 4000))
    assert sum(map(len, frames)) == 1206 and frames[0]["c0"][0] == "a" * 10 and [list(x) for x in frames[0]["c1"][0]] == [[1.0], [2.0, 3.0]]
    times = pa.StructArray.from_arrays([pa.array([0], pa.timestamp("us", "Europe/Berlin")), pa.array([[("k", 1)]], pa.map_(pa.string(), pa.int64()))], ["t", "m"])
    frame = next(batches.pieces(iter([times])))
    assert str(frame["t"][0]) == "1970-01-01 01:00:00" and frame["m"][0] == {"k": 1}
