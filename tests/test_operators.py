"""Universes, decisions, shards, batches, speakers."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import batching as B
from tessella.operators import decisions as D
from tessella.operators import shards as H
from tessella.operators import speakers as K
from tessella.operators import universe as U


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(0, "a", 10, "ok"), (1, "b", 20, "bad"), (2, "c", 30, None), (3, "d", 40, "ok")], "sample_index long, sample_id string, value int, label string")


def test_dense_numbers(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = U.number_rows(rows, ["k"]).collect()
    assert sorted((r["sample_index"], r["k"]) for r in got) == [(i, i) for i in range(1000)]
    assert U.number_rows(rows.limit(0), ["k"]).collect() == []
    assert U.check_dense(U.number_rows(rows, ["k"])) == 1000
    for bad in ([(0,), (2,)], [(0,), (0,)], [(None,)], [(1,)]):
        with pytest.raises(ValueError):
            U.check_dense(spark.createDataFrame(bad, "sample_index long"))


def test_three_valued_selection(four):
    s = U.Selection(four).also(U.select_labels(F.col("label"), "ok"))
    assert [r["x"] for r in four.select(s.selected.alias("x")).collect()] == [True, False, None, True]
    assert s.first_unknown() == 2 and s.selected_index(0) == 0
    for bad in (lambda: s.rows(), lambda: s.selected_index(1), lambda: s.selected_index(-1)):
        with pytest.raises(U.UnknownDecisionError) as e:
            bad()
        assert e.value.index == 2
    settled = s.also(F.col("value") != 30)  # false wins over unknown
    assert [r["sample_index"] for r in settled.rows().orderBy("position").collect()] == [0, 3]
    assert settled.selected_index(1) == settled.selected_index(-1) == 3
    for out in (2, -3):
        with pytest.raises(IndexError):
            settled.selected_index(out)


def test_published_prefix_is_never_unknown(four):
    got = four.select(U.prefix_selected(F.col("sample_index"), F.col("label"), 3, "ok").alias("x")).collect()
    assert [r["x"] for r in got] == [True, False, False, False]


def test_rebase_and_project(spark, four):
    target = spark.createDataFrame([(0, "c"), (1, "a"), (2, "d"), (3, "b")], "sample_index long, sample_id string")
    labels = four.select("sample_index", "label")
    assert {r["sample_index"]: r["label"] for r in U.rebase(labels, four, target).collect()} == {0: None, 1: "ok", 2: "ok", 3: "bad"}
    part = target.where("sample_index < 2")
    assert {r["sample_index"]: r["label"] for r in U.project(labels, four, part).collect()} == {0: None, 1: "ok"}
    for bad in (part, target.union(target.limit(1))):
        with pytest.raises(ValueError):
            U.rebase(labels, four, bad)
    with pytest.raises(ValueError):
        U.project(labels, four, spark.createDataFrame([(0, "z")], "sample_index long, sample_id string"))


def test_index_selection_and_live_merge(spark, four):
    picked = U.index_selection(four, spark.createDataFrame([(3,), (1,)], "sample_index long"))
    assert [(r["sample_index"], r["global_index"]) for r in picked.orderBy("sample_index").collect()] == [(0, 1), (1, 3)]
    for bad in ([(1,), (1,)], [(4,)], [(-1,)]):
        with pytest.raises((ValueError, IndexError)):
            U.index_selection(four, spark.createDataFrame(bad, "sample_index long"))
    a = spark.createDataFrame([(0, "x")], "sample_index long, label string")
    assert U.merge_live(a, a).count() == 1
    with pytest.raises(Exception, match="conflicting"):
        U.merge_live(a, spark.createDataFrame([(0, "y")], "sample_index long, label string")).collect()


def test_combine_items(spark):
    a = spark.createDataFrame([(0, (("hi",), ("en",)))], "sample_index long, default_text struct<views:struct<text:string>,meta:struct<lang:string>>")
    b = spark.createDataFrame([(0, ((["s"],), ("en", 5)))], "sample_index long, default_text struct<views:struct<speakers:array<string>>,meta:struct<lang:string,source_index:long>>")
    r = U.combine(a, b).first()["default_text"].asDict(True)
    assert r == {"views": {"speakers": ["s"], "text": "hi"}, "meta": {"lang": "en", "source_index": 5}}
    with pytest.raises(ValueError):
        U.combine(a, a)
    c = spark.createDataFrame([(0, ((["s"],), ("fr", 5)))], b.schema)
    with pytest.raises(Exception, match="differs"):
        U.combine(a, c).collect()


def test_labels_and_metrics():
    assert D.unique_labels(True, "x", False, "x") == ["accept", "x", "reject"]
    for bad in ("", None, 3):
        with pytest.raises(ValueError):
            D.normalize_label(bad)
    assert D.check_metrics({"a": [1, 2.5, None, "x"]})
    for bad in ({1: 2}, {"a": float("inf")}, {"a": {1}}):
        with pytest.raises((TypeError, ValueError)):
            D.check_metrics(bad)


def test_decisions_are_published_once(tmp_path, four):
    calls = []

    def decide(rows):
        calls.append(1)
        return rows.withColumn("label", F.col("value") > 15).withColumn("metrics", F.struct("value"))

    rule, universe = D.FilterRule("big", decide), U.Universe.of(four.drop("label"), "u1")
    done, report = rule.apply_with_report(universe, str(tmp_path))
    assert done.counts() == {"accept": 3, "reject": 1} and not report.reused and report.rate > 0
    again, second = rule.apply_with_report(universe, str(tmp_path))
    assert second.reused and len(calls) == 1 and again.labels() == ["accept", "reject"]
    assert [r["sample_id"] for r in done.select_by("reject").collect()] == ["a"] and done.select_by("accept", "reject").count() == 4
    assert {r["metrics"] for r in done.decisions().collect()} == {f'{{"value":{v}}}' for v in (10, 20, 30, 40)}
    home = rule.home(str(tmp_path), universe)
    with D.Lease(done.generation):
        fresh = rule.apply(universe, str(tmp_path), refresh=True)
        assert D.clean_up(home) == []
    assert D.clean_up(home) == [done.generation.name] and D.ready(home) == fresh.generation
    (fresh.generation / "manifest.json").unlink()
    assert "manifest" in D.why_not_ready(home)
    assert D.FilterRule("big", decide, version="2") != rule and D.FilterRule("big", len) == rule
    with pytest.raises(Exception, match="needs a label"):
        D.FilterRule("none", lambda r: r.withColumn("label", F.lit(None).cast("string"))).decisions(four.drop("label")).collect()


def test_windows(tmp_path, four):
    view = D.DecisionView(D.FilterRule("odd", lambda r: r.withColumn("label", F.col("sample_index") % 2 == 1)), U.Universe.of(four.drop("label"), "u2"), str(tmp_path))
    with pytest.raises(LookupError):
        view.load()
    assert view.produce(3) == 3 and view.status() == {"covered": 3, "total": 4, "sealed": False}
    assert [r["sample_index"] for r in view.select("accept").collect()] == [1]
    assert view.produce(3) == 4 and view.status()["sealed"] and view.produce(1) == 4
    assert sorted(r["sample_index"] for r in view.select(True).collect()) == [1, 3]
    decided = D.resume(view.rule, view.universe, view.load()[0].where("sample_index < 2"))
    assert decided.count() == 4


def test_shards(spark):
    rows = spark.range(10).withColumnRenamed("id", "sample_index")
    assert [r[0] for r in H.modulo_shard(rows, 3, 1).collect()] == [1, 4, 7] and H.runtime_shard(rows, 3, 0, 10).count() == 3
    assert H.nested_shard(2, 1, 3, 2) == (6, 5) and H.index_range(rows, 2, 5).count() == 3
    with pytest.raises(ValueError):
        H.modulo_shard(rows, 3, 3)
    some = rows.where("sample_index in (0, 1, 2, 5, 7, 8)")
    assert [r[0] for r in H.missing_indexes(spark, some, 10).orderBy("sample_index").collect()] == [3, 4, 6, 9]
    for bucket in (1 << 20, 2):
        assert sorted(tuple(r) for r in H.runs(some, "sample_index", bucket=bucket).collect()) == [(0, 2, 3), (5, 5, 1), (7, 8, 2)]
    assert H.describe_runs(some) == "0-2, 5, 7-8" and H.describe_runs(some, limit=1) == "0-2, ..."


def test_shuffles():
    out = H.shuffle_groups([0, 1, 2], [4, 3, 5], seed=7, epoch=1)
    assert sorted(x for g in out for x in g) == list(range(12)) and out == H.shuffle_groups([0, 1, 2], [4, 3, 5], seed=7, epoch=1) != H.shuffle_groups([0, 1, 2], [4, 3, 5], seed=7, epoch=2)
    parts = [[x for g in H.shuffle_groups([0, 1, 2], [4, 3, 5], 7, 1, 2, r) for x in g] for r in (0, 1)]
    flat = [x for g in out for x in g]
    assert parts == [flat[0::2], flat[1::2]]


def test_next_accepted(spark):
    rng = random.Random(5)
    ok = [rng.random() < 0.3 for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(ok)), "sample_index long, accepted boolean")
    want = [next(((i + k) % 300 for k in range(9) if ok[(i + k) % 300]), None) for i in range(300)]
    assert [r["served"] for r in H.next_accepted(rows, 300, 8).orderBy("sample_index").collect()] == want
    with pytest.raises(RuntimeError):
        H.guard_reject_ratio(rows, 0.2, 50)
    H.guard_reject_ratio(rows.withColumn("accepted", F.lit(True)), 0.2, 50)


def brute_plan(costs, p):
    """The plan by trying every contiguous range of the waiting samples."""
    window, waiting, fed, out = (1 if p.max_batch_samples == 1 else p.planning_window), [], 0, []
    pad = lambda c: (max(c) * len(c) - sum(c)) / (max(c) * len(c))
    while True:
        while len(waiting) < window and fed < len(costs):
            waiting.append(fed)
            fed += 1
        if not waiting:
            return out
        if costs[waiting[0]] > p.max_batch_memory:
            raise ValueError
        line = sorted(waiting, key=lambda i: (costs[i], i))
        ranges = [(a, b) for a in range(len(line)) for b in range(a + 1, len(line)) if sum(costs[i] for i in line[a : b + 1]) <= p.max_batch_memory and b - a < (p.max_batch_samples or len(line))]
        facts = [(a, b, sum(costs[i] for i in line[a : b + 1]), pad([costs[i] for i in line[a : b + 1]]), min(line[a : b + 1])) for a, b in ranges]
        close = [f for f in facts if f[3] <= p.max_padding_ratio]
        if close:
            a, b = max(close, key=lambda f: (f[2], -f[3], -f[4], -f[0], -f[1]))[:2]
        elif facts:
            a, b = max(facts, key=lambda f: (-f[3], f[2], -f[4], -f[0], -f[1]))[:2]
        else:
            a = b = line.index(max((i for i in line if costs[i] <= p.max_batch_memory), key=lambda i: (costs[i], -i)))
        out.append(sorted(line[a : b + 1]))
        waiting = [i for i in waiting if i not in out[-1]]


def test_plans_equal_exhaustive_search():
    assert B.plan_costs([100, 1, 100, 1, 100, 1], B.Plan(201, 6))[0] == [0, 2]
    rng = random.Random(9)
    for _ in range(400):
        costs = [rng.randint(1, 20) for _ in range(rng.randint(1, 30))]
        p = B.Plan(rng.randint(max(costs), 60), rng.randint(1, 12), rng.choice([None, 1, 2, 3, 8]), rng.choice([0.0, 0.05, 0.2, 0.5, 1.0]))
        assert B.plan_costs(costs, p) == brute_plan(costs, p)
    with pytest.raises(ValueError):
        B.plan_costs([1, 50], B.Plan(10))
    for bad in ([0], [True]):
        with pytest.raises(ValueError):
            B.plan_costs(bad, B.Plan(10))


def test_unit_costs_have_a_closed_form(spark):
    rows = spark.range(100).withColumnRenamed("id", "sample_index")
    for p in (B.Plan(7), B.Plan(7, 5), B.Plan(9, 8, 3)):
        group = F.floor(F.col("sample_index") / 40)
        a = B.plan_batches(rows, F.lit(1), p, group).drop("cost")
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, B.unit_batches(rows, p, group).collect()))


def test_collation(spark):
    rows = spark.createDataFrame([(0, 1, [1, 2, 3]), (0, 0, [4]), (1, 2, [])], "b int, i int, v array<int>")
    got = {r["b"]: r for r in B.collate_arrays(rows, ["b"], "i", "v", F.lit(0)).collect()}
    assert got[0]["v"] == [[4, 0, 0], [1, 2, 3]] and got[0]["mask"] == [[True, False, False], [True] * 3] and got[0]["lengths"] == [1, 3] and got[1]["v"] == [[]]
    waves = spark.createDataFrame([(0, 0, ([[1.0, 2.0]], 4)), (0, 1, ([[3.0]], 8))], "b int, i int, w struct<data:array<array<float>>,sample_rate:int>")
    r = B.collate_waveforms(waves, ["b"], "i", "w").first()
    assert r["data"] == [[[1.0, 2.0]], [[3.0, 0.0]]] and r["rates"] == [4, 8] and r["mask"][1] == [True, False]
    mixed = waves.union(spark.createDataFrame([(0, 2, ([[1.0], [1.0]], 4))], waves.schema))
    with pytest.raises(Exception, match="one shape"):
        B.collate_waveforms(mixed, ["b"], "i", "w").collect()
    codes = spark.createDataFrame([(0, 0, [[1, 2]]), (0, 1, [[3, 4], [5, 6]])], "b int, i int, c array<array<int>>")
    assert B.collate_codes(codes, ["b"], "i", "c").first()["c"] == [[[1, 2], [0, 0]], [[3, 4], [5, 6]]]


def test_rank_trim(spark):
    rows = spark.createDataFrame([(r, b) for r, n in ((0, 3), (1, 2)) for b in range(n)], "r int, b int")
    assert sorted(map(tuple, H.rank_trim(rows, F.col("r"), F.col("b")).collect())) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_speakers(spark):
    rows = spark.createDataFrame([(0, "hello"), (1, "world")], "sample_index long, text string")
    assert [r["speaker_id"] for r in K.assign_speakers(rows, ["V", "R"], cycle=False).orderBy("sample_index").collect()] == ["V", "R"]
    with pytest.raises(ValueError):
        K.assign_speakers(rows, ["V"], cycle=False)
    with pytest.raises(Exception, match="another speaker"):
        K.assign_speakers(rows, ["V"], existing=F.lit("X")).collect()
    cells = K.cross_speakers(rows, ["V", "R"]).withColumn("codes", F.array(F.array(F.col("sample_index").cast("int"))))
    assert sorted((r["sample_index"], r["source_index"], r["speaker_id"]) for r in cells.collect()) == [(0, 0, "V"), (1, 0, "R"), (2, 1, "V"), (3, 1, "R")]
    grouped = K.group_speakers(cells, 2, "codes").orderBy("source_index").first()
    assert grouped["speakers"] == ["V", "R"] and grouped["lengths"] == [1, 1]
    with pytest.raises(Exception, match="broken speaker block"):
        K.group_speakers(cells.where("sample_index <> 3"), 2, "codes").collect()
    grid = K.grid_axes(cells.withColumn("role", F.lit("source")), ["source"])
    assert K.grid_select(grid, sources=[1], speakers=["R"]).count() == 1 and K.speaker_pairs(grid, "codes").count() == 2
    assert len(K.grid_by(grid, "full", "codes").first()["cells"]) == 4 and K.grid_by(grid, "speaker", "codes").count() == 2
    with pytest.raises(ValueError):
        K.grid_axes(cells.where("sample_index > 0").withColumn("role", F.lit("source")), ["source"])


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_numbers_are_dense_beyond_the_sample(spark, aqe):
    """Far more rows than splits are taken of, nulls and few distinct leading keys, computed several times."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        rows = spark.range(400_000, numPartitions=23).select((F.xxhash64("id") % 1000).alias("a"), F.when(F.col("id") % 50 > 0, (F.col("id") % 977).cast("string")).alias("b"), "id")
        out = U.number_rows(rows, ["a", "b", "id"])
        assert U.check_dense(out) == 400_000
        order = Window.partitionBy("a").orderBy("sample_index")
        wrong = out.withColumn("before", F.lag(F.struct("b", "id")).over(order)).where(F.col("before") > F.struct("b", "id")).count()
        edges = out.groupBy("a").agg(F.min("sample_index").alias("lo"), F.max("sample_index").alias("hi")).orderBy("a").collect()
        assert wrong == 0 and all(x["hi"] + 1 == y["lo"] for x, y in zip(edges, edges[1:]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_shard_outputs_are_checked(spark):
    rows = spark.createDataFrame([(k,) for k in range(1, 20, 4)], "sample_index long")
    assert H.check_shard_output(rows, 4, 1) == 5 and H.check_shard_output(rows, 4, 1, 18) == 5
    for bad, total in ((rows, 22), (rows, 17), (rows.union(rows.limit(1)), 18), (rows.where("sample_index <> 5"), None), (rows.withColumn("sample_index", F.col("sample_index") + 1), 18)):
        with pytest.raises(ValueError):
            H.check_shard_output(bad, 4, 1, total)
    assert H.check_shard_output(rows.limit(0), 4, 1, 1) == 0


def test_a_rank_without_batches_is_an_error(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (2, 0)], "r long, b long")
    assert H.rank_trim(rows, F.col("r"), F.col("b")).count() == 2
    with pytest.raises(ValueError, match=r"ranks \[1\]"):
        H.rank_trim(rows, F.col("r"), F.col("b"), ranks=3)
    assert H.rank_trim(rows.limit(0), F.col("r"), F.col("b"), ranks=3).collect() == []


def test_runs_go_on_across_borders(spark):
    rng = random.Random(4)
    for p in (0.5, 0.97):
        have = sorted(k for k in range(600) if rng.random() < p)
        got = sorted(map(tuple, H.runs(spark.createDataFrame([(k,) for k in have], "i long"), "i", bucket=16).select("start", "stop", "count").collect()))
        want = []
        for k in have:
            if want and want[-1][1] == k - 1:
                want[-1] = (want[-1][0], k, want[-1][2] + 1)
            else:
                want.append((k, k, 1))
        assert got == want


def test_selected_groups_keep_the_shuffle_of_the_universe(spark):
    chosen = [k for k in range(500) if k % 3]
    positions = spark.createDataFrame(list(zip(chosen, range(len(chosen)))), "sample_index long, position long")
    rows = H.selected_groups(positions, 3, 1, size=64).orderBy("rank_order").collect()
    assert [r["rank_order"] for r in rows] == list(range(len(chosen))) and {(r["sample_index"], r["position"]) for r in rows} == set(zip(chosen, range(len(chosen))))
    order = [r["group"] for r in rows]
    assert len([1 for a, b in zip(order, order[1:]) if a != b]) == len(set(order)) - 1 and order != sorted(order)
    parts = [[r["position"] for r in H.selected_groups(positions, 3, 1, 3, k, 64).orderBy("rank_order").collect()] for k in range(3)]
    assert parts == [[r["position"] for r in rows][k::3] for k in range(3)]


def test_live_decisions_must_be_complete(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "sample_index long, label string")
    assert U.finish_live(rows.where("label is not null"), 2).count() == 2
    for d, n in ((rows, 3), (rows.where("sample_index > 0"), 2)):
        with pytest.raises(ValueError, match="incomplete"):
            U.finish_live(d, n)


def test_differing_finds_nested_changes(spark):
    kind = "sample_index long, a struct<x:array<double>,y:string>"
    left = spark.createDataFrame([(0, ([1.0, float("nan")], None)), (1, ([0.0], "b")), (2, None), (3, ([], ""))], kind)
    right = spark.createDataFrame([(0, ([1.0, float("nan")], None)), (1, ([-0.0], "b")), (2, ([], None)), (4, None)], kind)
    assert sorted((r[0], r[1]) for r in U.differing(left, right).collect()) == [(2, ["a"]), (3, ["a"]), (4, ["a"])]


def test_speaker_blocks_and_views(spark):
    good = [(0, 5, "source"), (1, 5, "target"), (2, 7, "source"), (3, 7, "target")]
    cells = lambda rows: spark.createDataFrame(rows, "sample_index long, source_index long, role string")
    assert K.check_blocks(cells(good), ["source", "target"]).count() == 4
    for bad in ([*good[:3], (3, 8, "target")], [*good[:2], (2, 7, "target"), (3, 7, "source")], [*good, (4, 5, "source"), (5, 5, "target")], good[:3]):
        with pytest.raises(ValueError):
            K.check_blocks(cells(bad), ["source", "target"]).count()
    views = spark.createDataFrame([(0, (([1], [2], None),)), (1, (([1], None, None),))], "sample_index long, a struct<views:struct<p:array<int>,q:array<int>,r:array<int>>>")
    assert K.shared_view(views, "a", ["p", "q"]) == "p"
    with pytest.raises(ValueError, match="share"):
        K.shared_view(views, "a", ["q", "r"])
    with pytest.raises(ValueError):
        K.shared_view(views, "a", ["p"], "q")


def test_rejected_rows_are_replaced_from_the_buffer(spark):
    flags = [k < 10 or k >= 60 for k in range(80)]
    rows = spark.createDataFrame(list(enumerate(flags)), "sample_index long, accepted boolean").repartition(3)
    got = {r[0]: r[2] for r in H.replace_rejected(rows, 80, buffer_size=4, min_buffer=8, max_probe=5, seed=1).collect()}
    assert len(got) == 80 and all(got[k] == k for k in range(80) if flags[k]) and all(got[k] == 60 for k in range(55, 60))
    assert all(got[k] == 9 - (k * 2654435761 + 1) % 4 for k in range(10, 55)) and {got[k] for k in range(10, 55)} == {6, 7, 8, 9}
    with pytest.raises(Exception, match="no accepted row near or before row"):
        H.replace_rejected(rows, 80, min_buffer=11, max_probe=5).collect()
    with pytest.raises(ValueError):
        H.reject_alerts(rows, 0.5, 0.4)
