"""Quality rules and chains."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import quality as Q

TEXT = "struct<views:struct<text:string>,meta:struct<lang:string>>"


def texts(spark, *values, lang=None):
    return spark.createDataFrame([(i, ((v,), (lang,))) for i, v in enumerate(values)], f"sample_index long, default_text {TEXT}")


def pair(spark, source, target, langs=(None, None)):
    return spark.createDataFrame([(0, ((source,), (langs[0],)), ((target,), (langs[1],)))], f"sample_index long, source_text {TEXT}, target_text {TEXT}")


def judged(rule, rows):
    return [(r["label"], r["flags"]) for r in rule(rows).orderBy("sample_index").select(f"{rule.name}.*").collect()]


def test_text_findings(spark):
    got = judged(Q.TextQuality(), texts(spark, "A good line.", None, " ", "a" * 30, "\x01\x02ab", "слово слово", "слово words", "да"))
    flags = [[], ["default_invalid_text", "default_empty_text"], ["default_empty_text"], ["default_long_repeated_run"], ["default_control_chars"], ["default_script_mismatch"], [], []]
    assert [f for _, f in got] == flags and [x for x, _ in got] == ["reject" if f else "accept" for f in flags]
    assert judged(Q.TextQuality(), texts(spark, "bonjour", lang="fr"))[0] == ("reject", ["default_lang_mismatch"])
    assert judged(Q.TextQuality(profile=Q.TextProfile(min_script_ratio=0.9)), texts(spark, "words слово"))[0] == ("reject", ["default_script_low"])


def test_profiles_are_checked():
    for bad in ({"min_script_ratio": 2}, {"reject_script_ratio": 0.9}, {"min_chars": 0}, {"max_control_ratio": float("nan")}):
        with pytest.raises(ValueError):
            Q.TextProfile(**bad)
    with pytest.raises(ValueError):
        Q.PairProfile("en", "fr", review_max_ratio=30)


@pytest.mark.parametrize(
    "source, target, flags",
    [
        ("hello there", "bonjour", []),
        (None, "x", ["invalid_pair_text", "target_short"][:1]),
        ("a" * 10 + " b" * 40, "x", ["target_extremely_short"]),
        ("abcdefghij", "x", ["target_short"]),
        ("ab", "x" * 50, ["target_extremely_long"]),
        ("ab", "xyzw" * 4, ["target_long"]),
        ("Same Words", "same  words", ["identical_text"]),
        ("Hi {name} now", "Salut {nom} x", ["placeholder_mismatch"]),
        ("<b>bold</b>", "<i>gras</i>", ["html_tag_mismatch"]),
        ("in the late days", "en fin de temps", ["complex_numbers"]),
        ("3 cats here", "4 chats ici", ["number_value_mismatch"]),
        ("1,000 cats", "1000 chats", ["number_surface_mismatch"]),
    ],
)
def test_pair_rules(spark, source, target, flags):
    ((label, got),) = judged(Q.TranslationQuality(Q.PairProfile("en", "fr")), pair(spark, source, target))
    if source is None:
        assert label == "reject" and got[0] == "invalid_pair_text"
    else:
        assert got == flags and label == ("reject" if set(flags) - {"number_surface_mismatch"} else "accept")


def test_chinese_pair(spark):
    rule = Q.TranslationQuality(Q.PairProfile("zh", "en"))
    assert judged(rule, pair(spark, "这里有5万人参加活动", "Here 50,000 people took part"))[0] == ("accept", ["number_surface_mismatch"])
    assert judged(rule, pair(spark, "这里有5万人参加活动", "Here 5,000 people took part"))[0] == ("reject", ["number_value_mismatch"])


def test_chain_lifts_a_rejection_to_review(spark):
    rows = pair(spark, "你好 world", "bonjour monde")
    text = Q.TextQuality("source", "en", Q.TextProfile(min_script_ratio=0.9, reject_script_ratio=0.5), "text")
    score = Q.ModelScore(lambda: lambda b: [0.1] * len(b), ("source_text.views.text",), name="score")
    chain = Q.QualityChain((text, Q.TranslationQuality(Q.PairProfile("en", "fr"), "pair")))
    r = chain(rows).select("quality.*").first()
    assert r["label"] == "review" and r["flags"] == ["text:source_script_low"]
    assert [tuple(x) for x in r["transitions"]] == [("text", "accept", "reject"), ("pair", "reject", "review")]
    assert Q.QualityChain((*chain.rules, score))(rows).select("quality.label").first()[0] == "reject"
    with pytest.raises(ValueError):
        Q.QualityChain((text, text))


def test_fold_table(spark):
    names = ("accept", "review", "reject")
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").select("a", "b", Q.fold(F.col("a"), F.col("b")).alias("c")).collect()
    got = {(r["a"], r["b"]): r["c"] for r in rows}
    want = {"accept": ("accept", "review", "reject"), "review": ("review", "review", "reject"), "reject": ("review", "reject", "reject")}
    assert got == {(a, b): want[a][k] for a in names for k, b in enumerate(names)}


def test_scores_and_corrections(spark):
    rows = texts(spark, "good text", "bad", None)
    assert judged(Q.ModelScore(lambda: lambda b: [0.6 if "good" in x else 0.59 for x in b["c0"]], ("default_text.views.text",)), rows) == [("accept", []), ("reject", ["score_low"]), ("reject", ["invalid_text"])]
    fix = Q.CorrectionDistance(lambda: lambda t: [x.replace("bad", "bat") for x in t])
    assert judged(fix, rows) == [("accept", []), ("reject", ["default_edit_ratio_high"]), ("reject", ["default_invalid_text"])]


def test_speech(spark):
    kind = "sample_index long, default_audio struct<views:struct<waveform:struct<data:array<array<float>>,sample_rate:int>>>, default_text struct<views:struct<text:string>>, e struct<utmos:double,wer:double,chrf:double,bleu:double>"
    good = (3.0, 0.1, 80.0, 40.0)
    rows = [
        (0, ((([[0.5] * 8], 4),),), (("two words",),), good), (1, ((([[0.01] * 40], 4),),), (("one",),), good), (2, (((None, 4),),), (("x",),), good),
        (3, ((([[float("nan")]], 4),),), (("x",),), good), (4, ((([[0.5]], 0),),), ((" ",),), good), (5, ((([[0.5] * 4], 4),),), (("x",),), (1.0, 0.9, 10.0, 1.0)),
    ]
    out = Q.SpeechQuality(scores="e", profile=Q.SpeechProfile(max_wer=0.5, min_bleu=5.0))(spark.createDataFrame(rows, kind)).orderBy("sample_index").select("speech_quality.*").collect()
    assert [r["flags"] for r in out] == [[], ["default_duration_per_text_unit_high", "default_peak_amplitude_low"], [], ["default_non_finite_waveform"], [], ["default_utmos_low", "default_wer_high", "default_chrf_low", "default_bleu_low"]]
    assert out[2]["warnings"] == ["default_missing_waveform"] and out[4]["warnings"] == ["default_invalid_sample_rate", "default_empty_text"] and out[0]["metrics"]["duration_seconds"] == 2.0


def test_models_get_bounded_pieces(spark):
    many = ["x" * (1 + i % 5) * (400_000 if i in (3, 900) else 1) for i in range(1000)]
    rows = texts(spark, *many, None).coalesce(1)

    def factory():
        def scorer(b):
            assert len(b) <= 256 and (len(b) == 1 or b["c0"].str.len().sum() <= 1 << 20)
            return [0.6 if len(x) > 3 else 0.2 for x in b["c0"]]

        return scorer

    got = judged(Q.ModelScore(factory, ("default_text.views.text",)), rows)
    assert [x[0] for x in got] == ["accept" if len(x) > 3 else "reject" for x in many] + ["reject"]

    def corrector():
        def correct(t):
            assert len(t) <= 256 and (len(t) == 1 or sum(map(len, t)) <= 1 << 20)
            return [x.replace("xxxx", "yyyy", 1) if len(x) == 4 else x for x in t]

        return correct

    short = texts(spark, *(x[:9] for x in many), None).coalesce(1)
    got = judged(Q.CorrectionDistance(corrector), short)
    assert [x[0] for x in got] == ["reject" if len(x[:9]) == 4 else "accept" for x in many] + ["reject"]
