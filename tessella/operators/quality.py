"""Quality rules over canonical samples: text, translation pair, speech, model scores, and chains of them.

A rule is a function DataFrame -> DataFrame that adds a struct column of its name: ``label`` (accept / review / reject), ``flags`` and what
it measured.  All are column expressions but for the number values of Chinese-English pairs and for model scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import batches as B
from ..functions import numbers as N
from ..functions import text as T

ACCEPT, REVIEW, REJECT = "accept", "review", "reject"


def _number(name: str, value: float, low: float, high: float = math.inf) -> None:
    """A plain number above ``low`` (or from 0, for ratios) and up to ``high``."""
    if type(value) not in (int, float):
        raise TypeError(f"{name} is no number: {value!r}")
    if not low <= value <= high or math.isinf(value):
        raise ValueError(f"{name} is out of range: {value!r}")


def _ratio(name: str, value: float) -> None:
    _number(name, value, 0, 1)


def _positive(name: str, value: float) -> None:
    _number(name, value, math.ulp(0.0))


def _flags(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Names whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in pairs)))


@dataclass(frozen=True)
class TextProfile:
    min_chars: int = 1
    min_script_ratio: float = 0.45
    reject_script_ratio: float = 0.2
    min_script_chars: int = 4
    max_control_ratio: float = 0.02
    max_repeated_run: int = 24

    def __post_init__(self):
        for name in ("min_script_ratio", "reject_script_ratio", "max_control_ratio"):
            _ratio(name, getattr(self, name))
        for name in ("min_chars", "min_script_chars", "max_repeated_run"):
            _positive(name, getattr(self, name))
        if self.reject_script_ratio > self.min_script_ratio:
            raise ValueError("reject_script_ratio is above min_script_ratio")


def findings(text: Column, item_lang: Column, lang: str, profile: TextProfile, m: Column) -> list[tuple[str, Column]]:
    """(finding, condition) in order, over metrics ``m`` of ``coalesce(text, '')``."""
    known = m["script_ratio"].isNotNull() & (m["script_chars"] >= profile.min_script_chars)
    low, lower = m["script_ratio"] < profile.min_script_ratio, m["script_ratio"] < profile.reject_script_ratio
    return [
        ("lang_mismatch", F.coalesce(item_lang, F.lit(lang)) != lang),
        ("invalid_text", text.isNull()),
        ("empty_text", m["chars"] < profile.min_chars),
        ("control_chars", m["control_ratio"] > profile.max_control_ratio),
        ("long_repeated_run", m["repeated_run"] >= profile.max_repeated_run),
        ("script_mismatch", known & lower),
        ("script_low", known & low & ~lower),
    ]


@dataclass(frozen=True)
class TextQuality:
    """Any finding rejects; flags are ``{role}_{finding}``."""

    role: str = "default"
    lang: str = "en"
    profile: TextProfile = TextProfile()
    name: str = "text_quality"

    def __call__(self, samples: DataFrame) -> DataFrame:
        item = f"{self.role}_text"
        text, m = F.col(f"{item}.views.text"), F.col(f"__{self.name}_m")
        has_meta = "meta" in samples.schema[item].dataType.names
        lang = F.col(f"{item}.meta.lang") if has_meta else F.lit(None).cast("string")
        out = samples.withColumn(f"__{self.name}_m", T.metrics(F.coalesce(text, F.lit("")), self.lang))
        flags = _flags([(f"{self.role}_{n}", c) for n, c in findings(text, lang, self.lang, self.profile, m)])
        out = out.withColumn(f"__{self.name}_f", T.bind(flags, lambda f: f))
        f = F.col(f"__{self.name}_f")
        result = F.struct(F.when(F.size(f) > 0, REJECT).otherwise(ACCEPT).alias("label"), f.alias("flags"), m["chars"].alias("chars"), m["control_ratio"].alias("control_ratio"), m["repeated_run"].alias("repeated_run"), m["script_chars"].alias("script_chars"), m["script_ratio"].alias("script_ratio"))
        return out.withColumn(self.name, result).drop(f"__{self.name}_m", f"__{self.name}_f")


@dataclass(frozen=True)
class PairProfile:
    source_lang: str
    target_lang: str
    review_min_ratio: float = 0.2
    review_max_ratio: float = 6.0
    reject_min_ratio: float = 0.05
    reject_max_ratio: float = 20.0
    min_identical_script_chars: int = 4

    def __post_init__(self):
        order = (self.reject_min_ratio, self.review_min_ratio, self.review_max_ratio, self.reject_max_ratio)
        for value in order:
            _positive("a length ratio", value)
        if list(order) != sorted(order):
            raise ValueError("length ratios must grow from reject_min to review_min, review_max and reject_max")
        _positive("min_identical_script_chars", self.min_identical_script_chars)


def _casefold(text: Column) -> Column:
    """Case-folded text as far as comparison needs it: lower case of upper case, sharp s as ss, final sigma as sigma."""
    return F.translate(F.replace(F.lower(F.upper(text)), F.lit("ß"), F.lit("ss")), "ς", "σ")


@dataclass(frozen=True)
class TranslationQuality:
    """Eleven rules, all evaluated; the last only flags, any other rejects."""

    profile: PairProfile
    name: str = "translation_quality"

    def __call__(self, samples: DataFrame) -> DataFrame:
        p, zh_en = self.profile, {self.profile.source_lang, self.profile.target_lang} == {"zh", "en"}
        out, sides = samples, []
        for role, lang in (("source", p.source_lang), ("target", p.target_lang)):
            item = f"{role}_text"
            text = F.col(f"{item}.views.text")
            out = out.withColumn(f"__{role}", T.metrics(F.coalesce(text, F.lit("")), lang))
            meta = F.col(f"{item}.meta.lang") if "meta" in samples.schema[item].dataType.names else F.lit(None).cast("string")
            sides.append((text, F.coalesce(meta, F.lit(lang)), F.col(f"__{role}")))
        (s_text, s_lang, s), (t_text, t_lang, t) = sides
        if zh_en:
            out = out.withColumn("__n", N.zh_en(p.source_lang == "zh")(s["normalized"], t["normalized"]))
            source, target, odd = F.col("__n.source"), F.col("__n.target"), F.col("__n.unsupported")
        else:
            values = lambda x: F.array_sort(T.number_values(x["numbers"]))
            odd = T.complex_numbers(s["normalized"]) | T.complex_numbers(t["normalized"])
            out = out.withColumn("__n", T.bind(F.struct(values(s).alias("source"), values(t).alias("target"), odd.alias("odd")), lambda n: n))
            source, target, odd = F.col("__n.source"), F.col("__n.target"), F.col("__n.odd")

        def slots(x: Column) -> Column:
            found = T.placeholders(x["normalized"])
            return F.array_sort(F.filter(found, lambda v: ~v.rlike(r"^\$\d+$")) if zh_en else found)

        ratio = T.length_ratio(s["chars"], t["chars"])
        some = (F.size(source) > 0) | (F.size(target) > 0) | (F.size(s["numbers"]) > 0) | (F.size(t["numbers"]) > 0)
        letters = F.greatest(s["script_chars"], t["script_chars"]) >= p.min_identical_script_chars
        rules = [
            ("invalid_pair_text", s_text.isNull() | t_text.isNull()),
            ("target_extremely_short", ratio < p.reject_min_ratio),
            ("target_short", (ratio >= p.reject_min_ratio) & (ratio < p.review_min_ratio)),
            ("target_extremely_long", ratio > p.reject_max_ratio),
            ("target_long", (ratio > p.review_max_ratio) & (ratio <= p.reject_max_ratio)),
            ("identical_text", (s_lang != t_lang) & (_casefold(s["normalized"]) == _casefold(t["normalized"])) & letters),
            ("placeholder_mismatch", slots(s) != slots(t)),
            ("html_tag_mismatch", F.array_sort(T.html_tags(s["normalized"])) != F.array_sort(T.html_tags(t["normalized"]))),
            ("complex_numbers", odd),
            ("number_value_mismatch", some & ~odd & (source != target)),
            ("number_surface_mismatch", some & ~odd & (source == target) & (T.overlap(s["numbers"], t["numbers"]) < 1)),
        ]
        out = out.withColumn("__flags", T.bind(_flags(rules), lambda f: f)).withColumn("__ratio", ratio)
        bad = F.size(F.array_except("__flags", F.array(F.lit("number_surface_mismatch")))) > 0
        result = F.struct(F.when(bad, REJECT).otherwise(ACCEPT).alias("label"), F.col("__flags").alias("flags"), F.col("__ratio").alias("char_ratio"), s["chars"].alias("source_chars"), t["chars"].alias("target_chars"))
        return out.withColumn(self.name, result).drop("__source", "__target", "__n", "__flags", "__ratio")


@dataclass(frozen=True)
class ModelScore:
    """Score of a model in [0, 1]; at least ``min_score`` accepts.  Covers acceptability of a text and adequacy of a pair.

    ``factory`` makes the scorer once for each task: it takes a pandas DataFrame of the ``columns``, at most 256 rows and fewer where they
    are large, and returns one number a row.  A null text rejects without a call.
    """

    factory: Callable[[], Callable[[pd.DataFrame], Sequence[float]]]
    columns: tuple[str, ...]
    min_score: float = 0.6
    name: str = "model_score"

    def __call__(self, samples: DataFrame) -> DataFrame:
        _ratio("min_score", self.min_score)
        factory, names = self.factory, self.columns

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scorer = factory()
            for batch in B.pieces(batches):
                out = pd.Series(float("nan"), index=batch.index)
                some = batch.notna().all(axis=1)
                if some.any():
                    values = [float(v) for v in scorer(batch[some])]
                    if len(values) != int(some.sum()) or not all(0 <= v <= 1 for v in values):
                        raise ValueError("a scorer must return one number from 0 to 1 for each row")
                    out[some] = values
                yield pa.array(out, pa.float64(), from_pandas=True)

        out = samples.withColumn("__s", score(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)))))
        lost = F.isnan("__s") | F.col("__s").isNull()
        flags = _flags([("invalid_text", lost), ("score_low", ~lost & (F.col("__s") < self.min_score))])
        result = F.struct(F.when(~lost & (F.col("__s") >= self.min_score), ACCEPT).otherwise(REJECT).alias("label"), flags.alias("flags"), F.when(~lost, F.col("__s")).alias("score"))
        return out.withColumn(self.name, result).drop("__s")


@dataclass(frozen=True)
class CorrectionDistance:
    """A corrector rewrites the text; rejects if the edit distance is above ``max_edits`` or ``max_edit_ratio`` times the text's characters."""

    factory: Callable[[], Callable[[list[str]], Sequence[str]]]
    role: str = "default"
    max_edit_ratio: float = 0.05
    max_edits: int | None = None
    name: str = "correction_distance"

    def __call__(self, samples: DataFrame) -> DataFrame:
        _ratio("max_edit_ratio", self.max_edit_ratio)
        factory, text = self.factory, T.normalize_space(F.col(f"{self.role}_text.views.text"))

        @F.arrow_udf("string")
        def correct(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            corrector = factory()
            for batch in B.pieces(batches):
                out, some = pd.Series([None] * len(batch), index=batch.index, dtype=object), batch["t"].notna()
                out[some] = list(corrector(batch["t"][some].tolist())) if some.any() else []
                yield pa.array(out, pa.string(), from_pandas=True)

        out = samples.withColumn("__t", text).withColumn("__c", correct(F.struct(F.col("__t").alias("t"))))
        edits = F.levenshtein("__t", "__c").cast("long")
        ratio = edits / F.greatest(T.nonspace_len(F.col("__t")), F.lit(1))
        tests = [("invalid_text", edits.isNull()), ("edit_count_high", edits > self.max_edits if self.max_edits is not None else F.lit(False)), ("edit_ratio_high", ratio > self.max_edit_ratio)]
        flags = _flags([(f"{self.role}_{n}", c) for n, c in tests])
        result = F.struct(F.when(F.size(flags) > 0, REJECT).otherwise(ACCEPT).alias("label"), flags.alias("flags"), edits.alias("edits"), ratio.alias("edit_ratio"))
        return out.withColumn(self.name, result).drop("__t", "__c")


@dataclass(frozen=True)
class SpeechProfile:
    # of the audio itself
    max_duration_seconds: float | None = None
    min_peak_amplitude: float | None = 0.05
    max_seconds_per_text_unit: float | None = 4.0
    # of an evaluator
    min_utmos: float = 2.8
    min_chrf: float = 50.0
    min_bleu: float | None = None
    max_wer: float | None = None

    def __post_init__(self):
        for name, value in vars(self).items():
            if value is not None:
                _number(name, value, -math.inf)


def speech_metrics(wave: Column, rate: Column, reference: Column) -> Column:
    units = T.text_units(reference)
    seconds = A.duration_seconds(wave, rate)
    return F.struct(seconds.alias("duration_seconds"), A.peak_amplitude(wave).alias("peak_amplitude"), units.cast("double").alias("text_units"), (seconds / units).alias("seconds_per_text_unit"))


@dataclass(frozen=True)
class SpeechQuality:
    """Audio against its text.  ``scores`` names a struct column with utmos, wer, chrf and bleu (of an evaluator UDF), if there is one.

    Missing audio or text only warns; samples that aren't finite reject.
    """

    role: str = "default"
    profile: SpeechProfile = SpeechProfile()
    scores: str | None = None
    name: str = "speech_quality"

    def __call__(self, samples: DataFrame) -> DataFrame:
        p, wave = self.profile, F.col(f"{self.role}_audio.views.waveform")
        text = T.normalize_space(F.col(f"{self.role}_text.views.text"))
        no_audio, no_rate = wave["data"].isNull(), wave["sample_rate"].isNull() | (wave["sample_rate"] <= 0)
        broken = ~no_audio & ~A.all_finite(wave["data"])
        ready = ~no_audio & ~no_rate & ~broken & text.isNotNull() & (text != "")
        out = samples.withColumn("__m", F.when(ready, speech_metrics(wave["data"], wave["sample_rate"], text)))
        m = F.col("__m")
        tests = [("non_finite_waveform", broken)]
        if self.scores:
            e = F.col(self.scores)
            tests += [("utmos_low", e["utmos"] < p.min_utmos)]
            tests += [("wer_high", e["wer"] > p.max_wer)] if p.max_wer is not None else []
            tests += [("chrf_low", e["chrf"] < p.min_chrf)]
        for flag, limit, cond in (
            ("duration_high", p.max_duration_seconds, lambda x: m["duration_seconds"] > x),
            ("duration_per_text_unit_high", p.max_seconds_per_text_unit, lambda x: m["seconds_per_text_unit"] > x),
            ("peak_amplitude_low", p.min_peak_amplitude, lambda x: m["peak_amplitude"] < x),
        ):
            tests += [(flag, cond(limit))] if limit is not None else []
        if self.scores and p.min_bleu is not None:
            tests += [("bleu_low", F.col(self.scores)["bleu"] < p.min_bleu)]
        flags = _flags([(f"{self.role}_{n}", c) for n, c in tests])
        warnings = _flags([(f"{self.role}_missing_waveform", no_audio), (f"{self.role}_invalid_sample_rate", ~no_audio & no_rate), (f"{self.role}_missing_text", text.isNull()), (f"{self.role}_empty_text", text == "")])
        result = F.struct(F.when(F.size(flags) > 0, REJECT).otherwise(ACCEPT).alias("label"), flags.alias("flags"), warnings.alias("warnings"), m.alias("metrics"))
        return out.withColumn(self.name, result).drop("__m")


def fold(previous: Column, current: Column) -> Column:
    """Label of a chain after one more rule: agreement stays, a first doubt after acceptance and an acceptance after a rejection are for review."""
    return (
        F.when(previous == ACCEPT, F.when(current == REJECT, REJECT).when(current == REVIEW, REVIEW).otherwise(ACCEPT))
        .when(previous == REJECT, F.when(current == ACCEPT, REVIEW).otherwise(REJECT))
        .otherwise(F.when(current == REJECT, REJECT).otherwise(REVIEW))
    )


@dataclass(frozen=True)
class QualityChain:
    """All rules run, none is skipped; labels fold in order; flags are ``rule:flag``."""

    rules: tuple
    name: str = "quality"

    def __post_init__(self):
        names = [r.name for r in self.rules]
        if not names or len(set(names)) < len(names):
            raise ValueError("a chain needs rules of different names")

    def __call__(self, samples: DataFrame) -> DataFrame:
        out = samples
        for rule in self.rules:
            out = rule(out)
        names = [r.name for r in self.rules]
        label, steps = F.lit(ACCEPT), []
        for n in names:
            after = fold(label, F.col(f"{n}.label"))
            steps.append(F.when(after != label, F.struct(F.lit(n).alias("rule"), label.alias("from"), after.alias("to"))))
            label = after
        named = lambda n: F.transform(F.col(f"{n}.flags"), lambda f: F.concat(F.lit(f"{n}:"), f))
        flags = F.flatten(F.array(*map(named, names)))
        return out.withColumn(self.name, F.struct(label.alias("label"), flags.alias("flags"), F.array_compact(F.array(*steps)).alias("transitions")))
