"""From source rows to canonical samples, declaratively: which columns (or nested fields) become which views and meta."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schema as S

Path = str | tuple[str, ...]


def field_of(path: Path) -> Column:
    """A column, or a field within nested structs and maps."""
    if isinstance(path, str):
        return F.col(path)
    out = F.col(path[0])
    for name in path[1:]:
        out = out[name]
    return out


@dataclass(frozen=True)
class Item:
    """views and meta: name -> path; constants: meta name -> value."""

    views: Mapping[str, Path] = field(default_factory=dict)
    meta: Mapping[str, Path] = field(default_factory=dict)
    constants: Mapping[str, object] = field(default_factory=dict)
    #: meta ``labels``: label name -> path
    labels: Mapping[str, Path] = field(default_factory=dict)
    sampling_rate: Path | int | None = None

    def column(self, name: str) -> Column:
        _, modality = S.parse_ref(name)
        views, meta = [], {}
        for view, path in self.views.items():
            if view not in S.VIEWS[modality]:
                raise ValueError(f"{name} has no view {view}")
            value = field_of(path)
            if view == "waveform":
                if self.sampling_rate is None:
                    raise ValueError("a waveform needs a sampling_rate")
                rate = F.lit(self.sampling_rate) if isinstance(self.sampling_rate, int) else field_of(self.sampling_rate)
                value = F.struct(value.cast("array<array<float>>").alias("data"), rate.cast("int").alias("sample_rate"))
            views.append(value.alias(view))
        if "labels" in self.meta and self.labels:
            raise ValueError("labels are given directly and by name")
        for m, path in self.meta.items():
            meta[m] = field_of(path)
        for m, value in self.constants.items():
            if m in meta:
                raise ValueError(f"meta {m} is given twice")
            meta[m] = F.lit(value)
        if self.labels:
            meta["labels"] = F.create_map(*(x for k, p in self.labels.items() for x in (F.lit(k), field_of(p).cast("string"))))
        if unknown := meta.keys() - S.META[modality].keys():
            raise ValueError(f"{name} has no meta {sorted(unknown)}")
        if "lang" in meta:
            meta["lang"] = S.remap_lang(meta["lang"])
        parts = [F.struct(*views).alias("views")] if views else []
        if meta:
            parts.append(F.struct(*(v.alias(k) for k, v in meta.items())).alias("meta"))
        return F.struct(*parts).alias(name)


def samples(rows: DataFrame, items: list[tuple[str, Item]], keep: tuple[str, ...] = ("sample_index", "sample_id")) -> DataFrame:
    """Canonical samples; an item named twice is an error."""
    names = [n for n, _ in items]
    if len(set(names)) < len(names):
        raise ValueError("an item is mapped twice")
    return rows.select(*(c for c in keep if c in rows.columns), *(item.column(n) for n, item in items))
