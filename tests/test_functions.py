"""Text, number and array functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from tessella import schema as S
from tessella.functions import arrays as A
from tessella.functions import numbers as N
from tessella.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def over(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_space_and_runs(spark):
    texts = ["  a \t\n b c　", "", "   ", "aaab\n\n\n\n", "x", "日日日"]
    assert over(spark, T.normalize_space, texts) == ["a b c", "", "", "aaab", "x", "日日日"]
    assert over(spark, T.nonspace_len, texts) == [3, 0, 0, 4, 1, 3]
    assert over(spark, T.longest_run, texts) == [2, 0, 3, 4, 1, 3]


def test_control_ratio(spark):
    texts = ["a\x00b\x07", "", "tab\tline\n\r", "z​w"]
    assert over(spark, T.control_ratio, texts) == [0.5, 0.0, 0.0, pytest.approx(1 / 3)]


def test_scripts(spark):
    assert over(spark, lambda t: T.script_ratio(t, "en"), ["hello", "привет", "<b>da</b> {slot} 12 дa", "123"]) == [1.0, 0.0, 0.75, None]
    assert over(spark, lambda t: T.script_ratio(t, "zh"), ["你好 ab", "〇"]) == [0.5, None]
    assert over(spark, lambda t: T.script_ratio(t, "ko"), ["한국어 a"]) == [0.75]
    for lang, text in {"ru": "слово", "ar": "كلمة", "hi": "हिन", "th": "ไทย", "he": "מלה"}.items():
        assert over(spark, lambda t, lang=lang: T.script_ratio(t, lang), [text])[0] == 1.0
    assert over(spark, lambda t: T.script_ratio(t, "el"), ["abc"]) == [None] and over(spark, lambda t: T.script_chars(t, "el"), ["abc"]) == [0]


def test_numbers(spark):
    assert over(spark, T.numbers, ["from 1,234.5 to -7 on 2024-01-02 at 10:30"]) == [["1,234.5", "-7", "2024-01-02", "10:30"]]
    values = {"1,234.50": "1234.5", "+07": "7", "-0.0": "-0", "0.10": "0.1", "12,34": "12,34", "1/2": "1/2", "000": "0", "100": "100", "1,000,000": "1000000"}
    assert over(spark, T.number_value, list(values)) == list(values.values())
    assert over(spark, T.complex_numbers, ["in the late 1990s", "3 万", "plain 12", "1-2", "two centuries", "decades", "amid", "middle"]) == [True, True, False, True, True, True, True, False]


def test_slots_tags_and_overlap(spark):
    assert over(spark, T.placeholders, ["{name} %s %(n)d $1 %d% 100%sure %5.2f"])[0] == ["{name}", "%s", "%(n)d", "$1", "%d", "%5.2f"]
    assert over(spark, T.html_tags, ["<B>x</B> <br/> a < b > c"])[0] == ["<b>", "</b>", "<br/>"]
    pair = F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "abb"))
    assert one(spark, T.overlap(*pair)) == 0.5 and one(spark, T.overlap(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0


def test_text_units(spark):
    assert over(spark, T.text_units, ["hello big world", "你好 world", "...", "", "été x", "abc你def"]) == [3, 3, 1, 1, 2, 3]


ACCEPTED = [
    ("共有3人", "3 people"), ("5万人", "50,000 people"), ("1.5亿", "150 million"), ("3月5日", None), ("20世纪80年代", "the 1980s"), ("5月份", "in May 5"),
    ("１２３", "123"), ("2000年", "in 2000"), ("1万亿", "1 trillion"), ("12月", "December"), ("3千", None), ("2万多亿元", "2 trillion"),
]


@pytest.mark.parametrize("zh, en", [c for c in ACCEPTED if c[1]])
def test_numbers_that_agree(zh, en):
    a, b, odd = N.compare(zh, en)
    if (zh, en) == ("5月份", "in May 5"):
        assert not odd and a == ["5"] and b == ["5", "5"]
    else:
        assert not odd and a == b


@pytest.mark.parametrize("zh, en, odd", [("3人", "4 people", False), ("3千人", "3,000", True), ("80年代", "the 1980s", True), ("三月", "mid March", True), ("1/2", "half", True), ("5月", "He may 5", True)])
def test_numbers_that_do_not(zh, en, odd):
    a, b, strange = N.compare(zh, en)
    assert strange == odd and (odd or a != b)


def test_number_udf_in_both_directions(spark):
    rows = spark.createDataFrame([("5万", "50 thousand"), (None, "7")], "zh string, en string")
    got = rows.select(N.zh_en(True)("zh", "en").alias("a"), N.zh_en(False)("en", "zh").alias("b")).collect()
    assert got[0]["a"]["source"] == got[0]["b"]["target"] == ["50000"] and got[1]["a"]["target"] == ["7"]


def test_padding(spark):
    row = spark.createDataFrame([([1, 2], [[1, 2], [3, 4]], [[1.0, -0.5], [0.0, 0.5]])], "v array<int>, c array<array<int>>, w array<array<float>>")
    r = row.select(A.pad(F.col("v"), F.lit(4), F.lit(0)).alias("p"), A.pad_mask(F.col("v"), F.lit(3)).alias("m"), A.pad_frames(F.col("c"), F.lit(3)).alias("f"), A.pad_channels(F.col("w"), F.lit(3)).alias("w"), A.mono(F.col("w")).alias("mono"), A.peak_amplitude(F.col("w")).alias("peak"), A.duration_seconds(F.col("w"), F.lit(4)).alias("s")).first()
    assert r["p"] == [1, 2, 0, 0] and r["m"] == [True, True, False] and r["f"] == [[1, 2], [3, 4], [0, 0]] and r["w"] == [[1.0, -0.5, 0.0], [0.0, 0.5, 0.0]]
    assert r["mono"] == [0.5, 0.0] and r["peak"] == 1.0 and r["s"] == 0.5
    q = row.select(A.codes_in_range(F.col("c"), [4, 5]).alias("ok"), A.codes_in_range(F.col("c"), [3, 5]).alias("low"), A.codes_in_range(F.col("c"), [9]).alias("shape"), A.all_finite(F.col("w")).alias("finite")).first()
    assert tuple(q) == (True, False, False, True)
    assert row.select(A.padding_ratio(F.lit(6), F.lit(4), F.lit(2)).alias("x")).first()["x"] == 0.25


def test_resample(spark):
    wave = F.array(*(F.lit(float(x)).cast("float") for x in (0, 1, 2, 3)))
    assert one(spark, A.resample(wave, F.lit(4), F.lit(8))) == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.0]
    assert one(spark, A.resample(wave, F.lit(4), F.lit(2))) == [0.0, 2.0] and one(spark, A.resample(wave, F.lit(4), F.lit(4))) == [0.0, 1.0, 2.0, 3.0]


def test_languages(spark):
    values = {" EN_us ": "en", "zh-Hant": "zh", "cmn": "zh", "und": "und"}
    assert over(spark, lambda t: S.remap_lang(t, {"cmn": "zh"}), list(values)) == list(values.values())
    with pytest.raises(Exception, match="unknown language"):
        over(spark, S.remap_lang, ["klingon"])


def test_required_fields(spark):
    rows = spark.createDataFrame([(0, (("hi", None), ("en", 1)))], "sample_index long, default_text struct<views:struct<text:string,speakers:array<string>>,meta:struct<lang:string,source_index:long>>")
    out = S.select(rows, S.Schema({"default_text": S.Requirement(("text",), ("lang",))}))
    assert out.first()["default_text"].asDict(True) == {"views": {"text": "hi"}, "meta": {"lang": "en"}}
    with pytest.raises(KeyError):
        S.select(rows, S.Schema({"source_text": S.Requirement(("text",))}))
    with pytest.raises(ValueError):
        S.Schema({"default_text": S.Requirement(("pixel",))})
    wrong = spark.createDataFrame([(0, ((5,),))], "sample_index long, default_text struct<views:struct<text:int>>")
    with pytest.raises(TypeError):
        S.select(wrong, S.Schema({"default_text": S.Requirement(("text",))}))
    assert S.Schema({"default_audio": S.Requirement(("waveform",), ("duration",))}).struct_type().names == ["default_audio"]
