"""Known data sets: where they are and how their rows map to samples (their exported tables are read; nothing is downloaded)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rowmap
from ..rowmap import Item
from ..schema import LANGS
from ..spec import Spec
from . import read


@dataclass(frozen=True)
class Preset:
    source: str
    split: str
    items: Callable[[Spec], list[tuple[str, Item]]]
    prepare: Callable[[DataFrame, Spec], DataFrame] = lambda rows, spec: rows

    def load(self, spark: SparkSession, path: str, split: str | None = None, version: str | None = None, **options: object) -> DataFrame:
        own = {k: options.pop(k) for k in ("source_lang", "target_lang", "languages") if k in options}
        spec = Spec.of(self.source, path, split or self.split, version, **options)
        rows = self.prepare(read(spark, spec), Spec(spec.source, spec.path, spec.split, version, (*spec.options, *own.items())))
        return rowmap.samples(rows, self.items(Spec(spec.source, spec.path, spec.split, version, (*spec.options, *own.items()))))


def _sound(meta: dict | None = None, labels: dict | None = None) -> Item:
    return Item({"waveform": ("audio", "array")}, meta or {}, labels=labels or {}, sampling_rate=("audio", "sampling_rate"))


def _fleurs(spec: Spec) -> list[tuple[str, Item]]:
    lang = str(dict(spec.options).get("config_name", "en_us")).split("_")[0]
    return [("default_audio", _sound()), ("default_text", Item({"text": "transcription"}, constants={"lang": {"cmn": "zh"}.get(lang, lang)}))]


def _wmt(spec: Spec) -> list[tuple[str, Item]]:
    o = dict(spec.options)
    a, b = o.get("source_lang", "cs"), o.get("target_lang", "en")
    if (config := o.get("config_name")) and {a, b} != set(str(config).split("-")):
        raise ValueError(f"{a} and {b} aren't the languages of {config}")
    if a == b or not {a, b} <= LANGS:
        raise ValueError(f"languages {a} and {b}")
    return [("source_text", Item({"text": ("translation", a)}, constants={"lang": a})), ("target_text", Item({"text": ("translation", b)}, constants={"lang": b}))]


def _voices(rows: DataFrame, spec: Spec) -> DataFrame:
    """Only the chosen languages; the audio path is joined to the directory of its language."""
    languages = dict(spec.options).get("languages")
    if languages:
        rows = rows.where(F.col("locale").isin(list(languages)))
    return rows.withColumn("file", F.struct(F.concat_ws("/", F.lit(spec.path), "locale", F.lit("clips"), "path").cast("binary").alias("data"), F.lit("path").alias("suffix")))


SPLITS = ("train", "dev", "test", "validated", "invalidated", "other", "reported")


def corpus_root(root: str, version: str | None = None) -> tuple[Path, str | None]:
    """(directory, version) of a voice corpus: ``root`` itself, or the ``cv-corpus-<version>..`` in it that is asked for, else the newest."""
    own = re.fullmatch(r"cv-corpus-(\d+(?:\.\d+)*)(?:-.*)?", Path(root).name)
    found = {}
    for d in Path(root).iterdir():
        if d.is_dir() and (m := re.fullmatch(r"cv-corpus-(\d+(?:\.\d+)*)(?:-.*)?", d.name)):
            found.setdefault(m[1], []).append(d)
    if not found:
        if version is not None and (own is None or version not in (own[1], own[0])):
            raise FileNotFoundError(f"{root} has no corpus of version {version}")
        return Path(root), own[1] if own else None
    if version is None:
        version = max(found, key=lambda v: tuple(map(int, v.split("."))))
    chosen = [d for v, ds in found.items() for d in ds if version in (v, d.name)]
    if not chosen:
        raise FileNotFoundError(f"{root} has versions {sorted(found)}, not {version}")
    if len(chosen) > 1:
        raise ValueError(f"version {version} is ambiguous: {sorted(d.name for d in chosen)}")
    return chosen[0], next(v for v, ds in found.items() if chosen[0] in ds)


def common_voice(spark: SparkSession, root: str, split: str = "train", languages: tuple[str, ...] | None = None, version: str | None = None) -> DataFrame:
    """Samples of a voice corpus: of one of its versions and some of its languages (all that have the split, if none are named), in their order."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    home, found = corpus_root(root, version)
    have = sorted(d.name for d in home.iterdir() if (d / f"{split}.tsv").is_file())
    wanted = list(dict.fromkeys(languages or have))
    if lost := [x for x in wanted if x not in have] or ([] if wanted else ["any language"]):
        raise FileNotFoundError(f"{home} has no {split}.tsv of {lost}")
    rows = read(spark, Spec.of("tsv", str(home), split, found, subdirs=tuple(wanted), root_field="_root"))
    clip = F.concat_ws("/", "_root", F.lit("clips"), "path")
    rows = rows.withColumn("file", F.struct(clip.cast("binary").alias("data"), F.lit("path").alias("suffix"))).drop("_root")
    return rowmap.samples(rows, PRESETS["common_voice"].items(Spec("tsv", str(home), split, found, ())))


PRESETS: dict[str, Preset] = {
    "mnist": Preset("table", "train", lambda s: [("default_image", Item({"pixel": ("image", "bytes")}, {"label": "label"}))]),
    "cifar10": Preset("table", "train", lambda s: [("default_image", Item({"pixel": ("img", "bytes")}, {"label": "label"}))]),
    "esc50": Preset("table", "train", lambda s: [("default_audio", _sound({"label": "category"}, {"target": "target", "esc10": "esc10"}))]),
    "fsd50k": Preset("files", "dev", lambda s: [("default_audio", Item({"file": "file"}))], lambda rows, s: rows.withColumn("file", F.struct(F.col("content").alias("data"), F.regexp_extract("path", r"\.([^.]+)$", 1).alias("suffix")))),
    "fleurs": Preset("table", "train", _fleurs),
    "librispeech_asr": Preset("table", "train.100", lambda s: [("default_audio", _sound({"speaker_id": "speaker_id"})), ("default_text", Item({"text": "text"}, constants={"lang": "en"}))]),
    "nsynth": Preset("table", "train", lambda s: [("default_audio", _sound(labels={"instrument": "instrument", "pitch": "pitch", "velocity": "velocity"}))]),
    "common_voice": Preset("tsv", "train", lambda s: [("default_audio", Item({"file": "file"}, {"speaker_id": "client_id"})), ("default_text", Item({"text": "sentence"}, {"lang": "locale"}))], _voices),
    "wmt19": Preset("table", "train", _wmt),
}
