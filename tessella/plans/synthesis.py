"""Growth of a pair corpus: which source rows become families, which pairs they give, and the published catalog of pairs.

Only cursors and counts are driver state; families and pairs are DataFrames.  A plan's admission order has a closed form, so it is one
sort with a limit instead of a loop.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.universe import identity, number_rows
from .files import lock, write_json

FAMILY = "slot string, row long, sequence long, language string, speaker_id string"
PAIR = "slot string, row long, target_language string, source_sequence long, first_for_source boolean"


@dataclass(frozen=True)
class Slot:
    name: str
    language: str


@dataclass(frozen=True)
class Config:
    languages: tuple[str, ...]
    slots: tuple[Slot, ...]
    speakers: tuple[str, ...]
    seed: int = 7
    initial_sources: int = 100
    interval_sources: int = 100
    lineage: str = "default"

    def __post_init__(self):
        for what, names in (("language", self.languages), ("slot", [s.name for s in self.slots]), ("speaker", self.speakers)):
            if not names or len(set(names)) < len(names):
                raise ValueError(f"{what} names must be unique, and at least one")
        if lost := {s.language for s in self.slots} - set(self.languages):
            raise ValueError(f"slots of undeclared languages {sorted(lost)}")

    @property
    def ordered_slots(self) -> tuple[Slot, ...]:
        return tuple(s for lang in self.languages for s in self.slots if s.language == lang)

    @property
    def lineage_id(self) -> str:
        return identity("lineage", lineage=self.lineage, seed=self.seed)

    def succeeds(self, old: Config) -> None:
        """Declarations only grow at their end."""
        for name in ("languages", "speakers"):
            a, b = getattr(old, name), getattr(self, name)
            if b[: len(a)] != a:
                raise ValueError(f"{name} must be appended to, {a} became {b}")
        for lang in old.languages:
            a, b = ([s.name for s in c.ordered_slots if s.language == lang] for c in (old, self))
            if b[: len(a)] != a:
                raise ValueError(f"slots of {lang} must be appended to")


@dataclass(frozen=True)
class State:
    config: Config
    cursors: dict[str, int] = field(default_factory=dict)
    next_slot: int = 0
    catchup: dict[str, int] = field(default_factory=dict)
    pool_revision: int = 0
    families: DataFrame | None = None
    pairs: DataFrame | None = None


@dataclass(frozen=True)
class Growth:
    phase: str  # initial, language_backfill, language_sources, vertical, idle
    families: DataFrame
    pairs: DataFrame
    state: State


def voice(seed: int, revision: int, slot: Column, row: Column, speakers: tuple[str, ...]) -> Column:
    """Speaker of a source: a hash of seed, pool revision, slot and row, modulo the pool."""
    text = F.concat_ws(":", F.lit(seed), F.lit(revision), slot, row)
    high = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.element_at(F.array(*map(F.lit, speakers)), (high % len(speakers)).cast("int") + 1)


def _spark(sources: dict[str, DataFrame]) -> SparkSession:
    return next(iter(sources.values())).sparkSession


def admit(config: Config, state: State, lengths: dict[str, int], limit: int, allowed: dict[str, int] | None, spark: SparkSession) -> tuple[DataFrame, State]:
    """The next families: slots take turns, each gives its rows in order, from ``next_slot`` on.

    The k-th new row of a slot is taken on turn k, so the order is (row - cursor, place after next_slot).  ``allowed``: only these
    languages, each up to so many families more.
    """
    slots = config.ordered_slots
    n, start = len(slots), state.next_slot % len(slots)
    rows = None
    for k, s in enumerate(slots):
        cursor = state.cursors.get(s.name, 0)
        if lengths[s.name] < cursor:
            raise ValueError(f"slot {s.name} shrank from at least {cursor} to {lengths[s.name]}")
        stop = min(lengths[s.name], cursor + limit)  # no slot gives more rows than the whole plan
        if allowed is not None and s.language not in allowed:
            continue
        part = spark.range(cursor, stop).select(F.lit(s.name).alias("slot"), F.col("id").alias("row"), F.lit(s.language).alias("language"), (F.col("id") - cursor).alias("turn"), F.lit((k - start) % n).alias("place"), F.lit(k).alias("at"))
        rows = part if rows is None else rows.union(part)
    if rows is None:
        return spark.createDataFrame([], FAMILY), state
    if allowed is not None:
        quota = F.create_map(*(F.lit(x) for kv in allowed.items() for x in kv))
        rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("language").orderBy("turn", "place"))).where(F.col("__k") <= F.element_at(quota, F.col("language"))).drop("__k")
    total = state.families.count() if state.families is not None else 0
    out = number_rows(rows, ["turn", "place"], "sequence").where(F.col("sequence") < limit).withColumn("sequence", F.col("sequence") + total)
    last = out.orderBy(F.desc("sequence")).select("at").first()
    cursors = dict(state.cursors)
    for r in out.groupBy("slot").agg(F.max("row").alias("row")).collect():
        cursors[r["slot"]] = r["row"] + 1
    families = out.select("slot", "row", F.col("sequence").cast("long").alias("sequence"), "language", voice(config.seed, state.pool_revision, F.col("slot"), F.col("row"), config.speakers).alias("speaker_id"))
    return families, replace(state, cursors=cursors, next_slot=(last["at"] + 1) % n if last else state.next_slot)


def pairs_of(config: Config, families: DataFrame) -> DataFrame:
    """Every family with every other language, in declaration order; the first is marked."""
    targets = F.filter(F.array(*map(F.lit, config.languages)), lambda x: x != F.col("language"))
    each = families.select("slot", "row", F.posexplode(targets).alias("__k", "target_language"), F.col("sequence").alias("source_sequence"))
    return each.select("slot", "row", "target_language", "source_sequence", (F.col("__k") == 0).alias("first_for_source"))


def backfill(config: Config, state: State, limit: int) -> DataFrame:
    """Pairs that families of before a new language lack, of at most ``limit`` families."""
    want = pairs_of(config, state.families).withColumn("first_for_source", F.lit(False))
    lost = want.join(state.pairs, ["slot", "row", "target_language"], "left_anti")
    first = lost.select("source_sequence").distinct().orderBy("source_sequence").limit(limit)
    return lost.join(F.broadcast(first), "source_sequence", "left_semi").select("slot", "row", "target_language", "source_sequence", "first_for_source")


def _expanded(config: Config, state: State) -> State:
    if config.lineage_id != state.config.lineage_id:
        raise ValueError("models or voices changed; start a new lineage")
    config.succeeds(state.config)
    if config == state.config:
        return state
    counts = {r["language"]: r["count"] for r in state.families.groupBy("language").count().collect()}
    target = max((counts.get(lang, 0) for lang in state.config.languages), default=0)
    catchup = state.catchup | {lang: target for lang in config.languages[len(state.config.languages) :]}
    names = [s.name for s in config.ordered_slots]
    old = [s.name for s in state.config.ordered_slots]
    return replace(state, config=config, catchup=catchup, pool_revision=state.pool_revision + (config.speakers != state.config.speakers), next_slot=names.index(old[state.next_slot % len(old)]))


def plan_growth(config: Config, lengths: dict[str, int], spark: SparkSession, state: State | None = None, sealed: frozenset[str] = frozenset()) -> Growth:
    """One append-only revision: missing pairs first, then languages that catch up, then new families."""
    initial = state is None
    now = State(config, families=spark.createDataFrame([], FAMILY), pairs=spark.createDataFrame([], PAIR)) if state is None else _expanded(config, state)
    limit = config.initial_sources if initial else config.interval_sources
    none = spark.createDataFrame([], FAMILY)

    def grown(phase: str, families: DataFrame, pairs: DataFrame, after: State) -> Growth:
        return Growth(phase, families, pairs, replace(after, families=after.families.union(families), pairs=after.pairs.union(pairs)))

    missing = backfill(config, now, limit)
    if not missing.isEmpty():
        return grown("language_backfill", none, missing, now)
    if now.catchup:
        counts = {r["language"]: r["count"] for r in now.families.groupBy("language").count().collect()}
        spent = {lang for lang in now.catchup if all(s.name in sealed and now.cursors.get(s.name, 0) >= lengths[s.name] for s in config.slots if s.language == lang)}
        need = {lang: n - counts.get(lang, 0) for lang, n in now.catchup.items() if n > counts.get(lang, 0) and lang not in spent}
        now = replace(now, catchup={lang: now.catchup[lang] for lang in need})
        if need:
            families, after = admit(config, now, lengths, limit, need, spark)
            if not families.isEmpty():
                return grown("language_sources", families, pairs_of(config, families), after)
    families, after = admit(config, now, lengths, limit, None, spark)
    if families.isEmpty():
        return Growth("idle", none, spark.createDataFrame([], PAIR), now)
    return grown("initial" if initial else "vertical", families, pairs_of(config, families), after)


def pair_records(families: DataFrame, pairs: DataFrame) -> DataFrame:
    """Index records: one for each pair, with its source's facts."""
    source = families.select("slot", "row", F.col("language").alias("source_language"), "speaker_id")
    both = pairs.join(source, ["slot", "row"])
    name = F.concat(F.col("slot"), F.lit(":"), F.col("row").cast("string"), F.lit("->"), F.col("target_language"))
    return both.select(name.alias("pair_id"), F.col("slot").alias("source_slot"), F.col("row").alias("source_row"), "source_sequence", "source_language", "target_language", "speaker_id", "first_for_source")


def summarize(records: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(source_sequence, source_slot, source_row, source_language, speaker_id, targets, first_target): one row for each source."""
    order = F.create_map(*(F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)))
    by = records.groupBy("source_sequence").agg(
        *(F.min(c).alias(c) for c in ("source_slot", "source_row", "source_language", "speaker_id")),
        F.sort_array(F.collect_list(F.struct(F.element_at(order, F.col("target_language")).alias("k"), F.col("target_language").alias("t")))).alias("__t"),
        F.max(F.when(F.col("first_for_source"), F.col("target_language"))).alias("first_target"),
        F.count_if("first_for_source").alias("__first"),
        F.countDistinct("source_slot", "source_row", "source_language").alias("__same"),
    )
    ok = F.when((F.col("__first") <= 1) & (F.col("__same") == 1), F.transform("__t", lambda x: x["t"])).otherwise(F.raise_error(F.lit("a source's records disagree")))
    return by.select("source_sequence", "source_slot", "source_row", "source_language", "speaker_id", ok.alias("targets"), "first_target")


def view(records: DataFrame, layout: str = "pairs", source_languages: list[str] | None = None, target_languages: list[str] | None = None, slots: list[str] | None = None, speakers: list[str] | None = None) -> DataFrame:
    """Pairs, or sources (the first selected record of each, without its target)."""
    for name, values in (("source_language", source_languages), ("target_language", target_languages), ("source_slot", slots), ("speaker_id", speakers)):
        if values is not None:
            records = records.where(F.col(name).isin(values))
    if layout == "pairs":
        return records
    if layout != "sources":
        raise ValueError(f"no layout {layout!r}")
    first = Window.partitionBy("source_slot", "source_row").orderBy(F.desc("first_for_source"), "source_sequence", "target_language")
    return records.withColumn("__k", F.row_number().over(first)).where("__k = 1").select("source_slot", "source_row", "source_sequence", "source_language", "speaker_id")


def coverage(records: DataFrame) -> DataFrame:
    return records.groupBy("source_language", "target_language").agg(F.count("*").alias("pairs"), F.countDistinct("source_sequence").alias("sources"))


class PairCatalog:
    """Append-only revisions of pair records, with totals and a digest; repeating a revision changes nothing, sealing ends it."""

    def __init__(self, root: str):
        self.home = Path(root)

    def entries(self) -> list[dict]:
        path = self.home / "catalog.json"
        return json.loads(path.read_text())["revisions"] if path.exists() else []

    @property
    def sealed(self) -> bool:
        path = self.home / "catalog.json"
        return path.exists() and json.loads(path.read_text())["sealed"]

    def read(self, spark: SparkSession) -> DataFrame:
        paths = [str(self.home / e["path"]) for e in self.entries()]
        if not paths:
            raise LookupError(f"{self.home} has no revision")
        return spark.read.parquet(*paths)

    def publish(self, records: DataFrame, revision: str, previous: str | None) -> dict:
        """Append ``records`` after ``previous``: sequences go on without a gap, no pair comes twice."""
        with lock(self.home / "lock"):
            done = self.entries()
            if done and done[-1]["revision"] == revision:
                return done[-1]
            if self.sealed:
                raise ValueError("the catalog is sealed")
            if (done[-1]["revision"] if done else None) != previous:
                raise ValueError(f"revision {previous} is not the last")
            path = f"revision-{len(done):06d}"
            records.write.mode("overwrite").parquet(str(self.home / path))
            rows = records.sparkSession.read.parquet(str(self.home / path))
            every = rows.unionByName(self.read(records.sparkSession)) if done else rows
            if not (twice := every.groupBy("pair_id").count().where("count > 1").limit(1)).isEmpty():
                raise ValueError(f"pair {twice.first()[0]} repeats")
            low, high, n, digest = every.agg(F.min("source_sequence"), F.max("source_sequence"), F.countDistinct("source_sequence"), F.sum(F.xxhash64("pair_id").cast("decimal(38,0)"))).first()
            if n and (low != 0 or high != n - 1):
                raise ValueError(f"source sequences {low} to {high} have gaps")
            entry = {"revision": revision, "previous": previous, "path": path, "pairs": rows.count(), "total_pairs": every.count(), "total_sources": n, "digest": str(digest)}
            write_json(self.home / "catalog.json", {"sealed": False, "revisions": [*done, entry]})
            return entry

    def seal(self) -> None:
        with lock(self.home / "lock"):
            write_json(self.home / "catalog.json", {"sealed": True, "revisions": self.entries()})

    def export(self, spark: SparkSession, target: str) -> None:
        """Records as JSON lines."""
        self.read(spark).write.json(target)

    def status(self, expected: int) -> dict[str, object]:
        done = self.entries()
        published = done[-1]["total_pairs"] if done else 0
        return {"expected": expected, "published": published, "pending": expected - published, "caught_up": published >= expected}

    def locate(self, spark: SparkSession, sources: DataFrame) -> DataFrame:
        """Records of the given (source_slot, source_row)."""
        return self.read(spark).join(sources, ["source_slot", "source_row"], "left_semi")


class Stage:
    """A consumer of a catalog that works through it by bounded, pinned suffixes."""

    def __init__(self, root: str, upstream: PairCatalog):
        self.home, self.upstream = Path(root), upstream

    def position(self) -> int:
        path = self.home / "stage.json"
        return json.loads(path.read_text())["revisions"] if path.exists() else 0

    def next_input(self, spark: SparkSession, max_revisions: int = 1) -> tuple[DataFrame | None, dict]:
        """Upstream records that come next, and the pin that :meth:`publish` needs."""
        entries, at = self.upstream.entries(), self.position()
        part = entries[at : at + max_revisions]
        pin = {"from": at, "to": at + len(part), "digest": part[-1]["digest"] if part else None}
        return (spark.read.parquet(*(str(self.upstream.home / e["path"]) for e in part)) if part else None), pin

    def publish(self, result: DataFrame, pin: dict) -> None:
        with lock(self.home / "lock"):
            entries = self.upstream.entries()
            if pin["from"] != self.position() or entries[pin["to"] - 1]["digest"] != pin["digest"]:
                raise ValueError("the input is stale")
            result.write.mode("overwrite").parquet(str(self.home / f"output-{pin['from']:06d}"))
            write_json(self.home / "stage.json", {"revisions": pin["to"], "digest": pin["digest"]})

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(*(str(p) for p in sorted(self.home.glob("output-*"))))


#: Stages of a synthesis and what each takes its input from.
UPSTREAM = {"translation": "source", "speech": "translation"}


def check_chain(child: dict, parent: dict) -> None:
    """Raises unless ``child``, a stage's snapshot manifest, was made of exactly the snapshot that ``parent`` describes."""
    if (want := UPSTREAM.get(child["stage"])) is None:
        raise ValueError(f"stage {child['stage']!r} has no upstream")
    if parent["stage"] != want:
        raise ValueError(f"stage {child['stage']!r} follows {want!r}, not {parent['stage']!r}")
    if (child["upstream_snapshot"], child["upstream_digest"]) != (parent["snapshot"], parent["digest"]):
        raise ValueError("the upstream snapshot is another than the parent")
    for name in ("lineage", "revision", "config_revision", "sources", "pairs", "coverage"):
        if child[name] != parent[name]:
            raise ValueError(f"{name} differs from the upstream's: {child[name]!r}, {parent[name]!r}")


def toy_sources(spark: SparkSession, rows: int, languages: tuple[str, ...]) -> DataFrame:
    """Samples of the source schema without any model: text and a short tone."""
    tone = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.sin(i * (F.col("id") % 7 + 1) / 4).cast("float"))
    lang = F.element_at(F.array(*map(F.lit, languages)), (F.col("id") % len(languages) + 1).cast("int"))
    return spark.range(rows).select(
        F.col("id").alias("sample_index"), F.format_string("%012d-toy", "id").alias("sample_id"),
        F.struct(F.struct(F.concat(F.lit("toy "), F.col("id").cast("string")).alias("text")).alias("views"), F.struct(lang.alias("lang")).alias("meta")).alias("source_text"),
        F.struct(F.struct(F.struct(F.array(tone).alias("data"), F.lit(16).alias("sample_rate")).alias("waveform")).alias("views")).alias("source_audio"),
    )
