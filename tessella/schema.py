"""The canonical sample: one struct column ``{role}_{modality}`` for each item, with nested ``views`` and ``meta``."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t


class Role(str, Enum):
    DEFAULT = "default"
    SOURCE = "source"
    TARGET = "target"


class Modality(str, Enum):
    AUDIO = "audio"
    IMAGE = "image"
    TEXT = "text"


WAVEFORM = t.StructType([t.StructField("data", t.ArrayType(t.ArrayType(t.FloatType()))), t.StructField("sample_rate", t.IntegerType())])
FILE = t.StructType([t.StructField("data", t.BinaryType()), t.StructField("suffix", t.StringType())])
CODES = t.ArrayType(t.ArrayType(t.IntegerType()))


def _pair(second: str) -> t.StructType:
    return t.StructType([t.StructField("semantic", CODES), t.StructField(second, CODES)])


#: View and meta names of each modality with their column types.
VIEWS: dict[Modality, dict[str, t.DataType]] = {
    Modality.AUDIO: {"waveform": WAVEFORM, "file": FILE, "longcat": _pair("acoustic"), "glm4": CODES, "moss": CODES, "qwen": CODES, "semantic_global": _pair("global")},
    Modality.IMAGE: {"pixel": t.BinaryType(), "file": FILE},
    Modality.TEXT: {"text": t.StringType(), "speakers": t.ArrayType(t.StringType())},
}
META: dict[Modality, dict[str, t.DataType]] = {
    Modality.AUDIO: {"duration": t.DoubleType(), "label": t.StringType(), "labels": t.MapType(t.StringType(), t.StringType()), "speaker_id": t.StringType(), "source_index": t.LongType()},
    Modality.IMAGE: {"label": t.StringType()},
    Modality.TEXT: {"lang": t.StringType(), "source_index": t.LongType()},
}

LANGS = frozenset("af ar be bg ca cs da de el en es et fa fi fr gu he hi hr hu id it ja kk ko lt lv mk ms nl no pl ps pt ro ru sk sl sr sv th tr uk und ur vi zh".split())


def ref(role: Role | str, modality: Modality | str) -> str:
    """Column name of an item."""
    return f"{Role(role).value}_{Modality(modality).value}"


def parse_ref(name: str) -> tuple[Role, Modality]:
    role, _, modality = name.partition("_")
    return Role(role), Modality(modality)


@dataclass(frozen=True)
class Requirement:
    """Views and meta fields that a consumer needs of one item."""

    views: tuple[str, ...] = ()
    meta: tuple[str, ...] = ()


@dataclass(frozen=True)
class Schema:
    """What a consumer needs, by item."""

    items: dict[str, Requirement] = field(default_factory=dict)

    def __post_init__(self):
        for name, need in self.items.items():
            _, modality = parse_ref(name)
            for kind, known in (("views", VIEWS), ("meta", META)):
                if unknown := set(getattr(need, kind)) - known[modality].keys():
                    raise ValueError(f"{name} has no {kind} {sorted(unknown)}")

    def struct_type(self) -> t.StructType:
        out = []
        for name, need in self.items.items():
            _, modality = parse_ref(name)
            parts = [t.StructField(kind, t.StructType([t.StructField(n, known[modality][n]) for n in getattr(need, kind)])) for kind, known in (("views", VIEWS), ("meta", META)) if getattr(need, kind)]
            out.append(t.StructField(name, t.StructType(parts)))
        return t.StructType(out)


def select(samples: DataFrame, schema: Schema, keep: tuple[str, ...] = ("sample_index", "sample_id")) -> DataFrame:
    """Exactly the required items, views and meta (nested columns are pruned at the scan); what is missing raises KeyError, a wrong type TypeError."""
    columns: list[Column | str] = [c for c in keep if c in samples.columns]
    for name, need in schema.items.items():
        if name not in samples.columns:
            raise KeyError(name)
        _, modality = parse_ref(name)
        own, parts = samples.schema[name].dataType, []
        for kind, known in (("views", VIEWS), ("meta", META)):
            wanted = getattr(need, kind)
            if not wanted:
                continue
            have = {f.name: f.dataType for f in own[kind].dataType.fields} if kind in own.names else {}
            for n in wanted:
                if n not in have:
                    raise KeyError(f"{name}.{kind}.{n}")
                if have[n].typeName() != known[modality][n].typeName():
                    raise TypeError(f"{name}.{kind}.{n} is {have[n].simpleString()}")
            parts.append(F.struct(*(F.col(f"{name}.{kind}.{n}") for n in wanted)).alias(kind))
        columns.append(F.when(F.col(name).isNotNull(), F.struct(*parts)).alias(name))
    return samples.select(*columns)


def items_json(samples: DataFrame) -> Column:
    """A sample's items as manifests have them, ``[[[role, modality], meta], ..]`` in the order of the columns; null items are left out."""
    out = []
    for f in samples.schema.fields:
        try:
            role, modality = parse_ref(f.name)
        except ValueError:
            continue
        meta = F.to_json(F.col(f"{f.name}.meta")) if "meta" in f.dataType.names else F.lit("{}")
        out.append(F.when(F.col(f.name).isNotNull(), F.concat(F.lit(f'[["{role.value}","{modality.value}"],'), F.coalesce(meta, F.lit("{}")), F.lit("]"))))
    return F.concat(F.lit("["), F.array_join(F.array_compact(F.array(*out)), ","), F.lit("]"))


def parse_items(text: str) -> dict[str, dict]:
    """(item, meta) of such a text; raises ValueError if it is of another shape."""
    items = json.loads(text)
    if not isinstance(items, list):
        raise ValueError("items must be an array")
    out = {}
    for entry in items:
        if not (isinstance(entry, list) and len(entry) == 2 and isinstance(entry[0], list) and len(entry[0]) == 2 and isinstance(entry[1], dict)):
            raise ValueError(f"an item must be [[role, modality], meta]: {entry!r}")
        name = ref(*entry[0])
        parse_ref(name)
        if name in out:
            raise ValueError(f"item {name} repeats")
        out[name] = entry[1]
    return out


def remap_lang(value: Column, remap: dict[str, str] | None = None) -> Column:
    """Language code: stripped, lower case, ``_`` as ``-``; looked up whole, then by its base tag; an unknown one is an error."""
    table = {lang: lang for lang in LANGS} | {k.lower().replace("_", "-"): v for k, v in (remap or {}).items()}
    tag = F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-"))
    codes = F.create_map(*(F.lit(x) for pair in sorted(table.items()) for x in pair))
    found = F.coalesce(F.element_at(codes, tag), F.element_at(codes, F.split(tag, "-")[0]))
    return F.when(value.isNull(), None).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("unknown language "), value))))
