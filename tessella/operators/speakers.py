"""Speaker assignment, text x speaker products, grouping and the dense speaker grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assign_speakers(samples: DataFrame, speakers: Sequence[str], cycle: bool = True, index: str = "sample_index", existing: Column | None = None) -> DataFrame:
    """Add speaker_id: the i-th of ``speakers``, in turn if ``cycle`` else one each; a sample that has another already is an error."""
    if not speakers:
        raise ValueError("no speakers")
    if not cycle and (n := samples.count()) != len(speakers):
        raise ValueError(f"{len(speakers)} speakers for {n} samples")
    given = F.element_at(F.array(*map(F.lit, speakers)), (F.pmod(F.col(index), F.lit(len(speakers))) + 1).cast("int"))
    if existing is not None:
        given = F.when(existing.isNull() | (existing == given), given).otherwise(F.raise_error(F.lit("a sample has another speaker already")))
    return samples.withColumn("speaker_id", given)


def cross_speakers(texts: DataFrame, speakers: Sequence[str], index: str = "sample_index") -> DataFrame:
    """Every text with every speaker: sample_index = source_index * speakers + speaker; no shuffle."""
    if not speakers:
        raise ValueError("no speakers")
    pairs = texts.withColumnRenamed(index, "source_index").select("*", F.posexplode(F.array(*map(F.lit, speakers))).alias("__s", "speaker_id"))
    return pairs.withColumn("sample_index", (F.col("source_index") * len(speakers) + F.col("__s")).cast("long")).drop("__s")


def group_speakers(cells: DataFrame, speakers: int, codes: str, text: str = "text", index: str = "sample_index") -> DataFrame:
    """(source_index, text, speakers, codes, lengths): the speakers' versions of each text; blocks must be whole and agree on text and source."""
    by = cells.withColumn("__row", F.floor(F.col(index) / speakers)).groupBy("__row")
    packed = by.agg(F.sort_array(F.collect_list(F.struct(index, "speaker_id", codes))).alias("__c"), F.countDistinct(text).alias("__t"), F.min(text).alias(text), F.countDistinct("source_index").alias("__s"), F.min("source_index").alias("source_index"))
    whole = (F.size("__c") == speakers) & (F.col("__t") == 1) & (F.col("__s") == 1) & (F.size(F.array_distinct(F.transform("__c", lambda c: c["speaker_id"]))) == speakers)
    lengths = F.transform("__c", lambda c: F.size(c[codes]).cast("long"))
    out = packed.withColumn("__ok", F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("broken speaker block "), F.col("__row").cast("string")))))
    return out.where("__ok").select("source_index", text, F.transform("__c", lambda c: c["speaker_id"]).alias("speakers"), F.transform("__c", lambda c: c[codes]).alias(codes), lengths.alias("lengths"))


def grid_axes(cells: DataFrame, roles: Sequence[str], index: str = "sample_index") -> DataFrame:
    """Add source_index, role and speaker position to rows of a dense source x role x speaker store; raises if it is not dense."""
    n, sources, speakers = cells.agg(F.count("*"), F.countDistinct("source_index"), F.countDistinct("speaker_id")).first()
    if n != sources * len(roles) * speakers:
        raise ValueError(f"{n} cells for {sources} sources x {len(roles)} roles x {speakers} speakers")
    if len(set(roles)) < len(roles):
        raise ValueError("a role repeats")
    twice = cells.groupBy("source_index", "role", "speaker_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"cell {tuple(twice[0])[:3]} repeats")
    return cells


def check_blocks(cells: DataFrame, roles: Sequence[str], index: str = "sample_index") -> DataFrame:
    """``cells``, or an error unless they are consecutive blocks of one source each with exactly ``roles`` in this order, no source having two blocks."""
    if len(set(roles)) < len(roles):
        raise ValueError("a role repeats")
    block = cells.withColumn("__block", F.floor(F.col(index) / len(roles))).groupBy("__block")
    told = block.agg(F.countDistinct("source_index").alias("sources"), F.min("source_index").alias("source"), F.transform(F.sort_array(F.collect_list(F.struct(index, "role"))), lambda x: x["role"]).alias("order"))
    bad = told.where((F.col("sources") != 1) | (F.col("order") != F.array(*map(F.lit, roles)))).orderBy("__block").limit(1).collect()
    if bad:
        raise ValueError(f"block {bad[0]['__block']} has {bad[0]['sources']} sources and roles {bad[0]['order']}, not {list(roles)}")
    twice = told.groupBy("source").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"source {twice[0]['source']} has several blocks")
    return cells


def shared_view(cells: DataFrame, item: str, usable: Sequence[str], requested: str | None = None) -> str:
    """The one view of ``usable`` that all cells have (not null); or ``requested``, if they have it."""
    names = [f.name for f in cells.schema[item].dataType["views"].dataType.fields]
    wanted = [requested] if requested else [v for v in usable if v in names]
    if missing := [v for v in wanted if v not in names]:
        raise ValueError(f"no cell has view {missing[0]}")
    total, *have = cells.agg(F.count("*"), *(F.count(f"{item}.views.{v}") for v in wanted)).first()
    common = [v for v, n in zip(wanted, have) if n == total]
    if not total or len(common) != 1:
        raise ValueError(f"cells must share one view, they share {common}" if total else "no cell is selected")
    return common[0]


def grid_select(cells: DataFrame, sources: Sequence[int] | None = None, roles: Sequence[str] | None = None, speakers: Sequence[str] | None = None) -> DataFrame:
    """Cells on the given axes values: filters that reach the scan."""
    for name, values in (("source_index", sources), ("role", roles), ("speaker_id", speakers)):
        if values is not None:
            cells = cells.where(F.col(name).isin(list(values)))
    return cells


def grid_by(cells: DataFrame, axis: str, codes: str) -> DataFrame:
    """The grid as nested arrays along one axis (``speaker``: by source and role; ``text``: by speaker; ``full``: all)."""
    keys = {"speaker": ["source_index", "role"], "text": ["speaker_id"], "full": []}[axis]
    rest = [c for c in ("source_index", "role", "speaker_id") if c not in keys]
    return cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest, codes))).alias("cells"))


def speaker_pairs(cells: DataFrame, codes: str) -> DataFrame:
    """Cells of the same source and role by two different speakers, each pair once."""
    a, b = (cells.select("source_index", "role", F.col("speaker_id").alias(f"{x}_speaker"), F.col(codes).alias(f"{x}_{codes}")) for x in ("left", "right"))
    return a.join(b, ["source_index", "role"]).where("left_speaker < right_speaker")
