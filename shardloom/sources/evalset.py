"""Evaluation sets: events, pixels with truth and a descriptor, written once and read by every run that is scored on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.operators.metrics import key_digest
from shardloom.sources.tables import PIXEL_TYPES


def first_events(events: DataFrame, pixels: DataFrame, most: int, order: str = "event_key") -> tuple[DataFrame, DataFrame]:
    """The first ``most`` events (all with 0) in the order of their keys, and their pixels. The cut-off key comes to the driver, no event does."""
    if most <= 0:
        return events, pixels
    last = events.select(order).orderBy(order).limit(most).agg(F.max(order).alias("k")).first()["k"]
    kept = events.where(F.col(order) <= F.lit(last)) if last is not None else events.limit(0)
    return kept, pixels.join(kept.select("event_idx"), "event_idx", "left_semi")


def violations(events: DataFrame, pixels: DataFrame, truth: list[str]) -> DataFrame:
    """(problem, n) of what would spoil a set: repeated or missing event keys, pixels of unknown events, and truth columns that
    are null for some rows but not for all (a tier that only part of the source has)."""
    key = events.groupBy("event_key").agg(F.count(F.lit(1)).alias("n"))
    rows = [
        key.where("event_key is null").agg(F.lit("event without key").alias("problem"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")),
        key.where("event_key is not null and n > 1").agg(F.lit("repeated event key").alias("problem"), F.count(F.lit(1)).alias("n")),
        pixels.join(events.select("event_idx"), "event_idx", "left_anti").agg(F.lit("pixel of no event").alias("problem"), F.count(F.lit(1)).alias("n")),
    ]
    for table in (events, pixels):
        own = [c for c in truth if c in table.columns]
        if own:
            counts = table.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in own])
            short = F.explode(F.array(*[F.struct(F.lit(f"truth column {c} is short").alias("problem"), F.when((F.col(c) > 0) & (F.col(c) < F.col("rows")), F.col("rows") - F.col(c)).otherwise(0).alias("n")) for c in own]))
            rows.append(counts.select(short.alias("s")).select("s.*"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where("n > 0")


@dataclass(frozen=True)
class EvalSet:
    """A set's descriptor: its name, the digest of its event keys, its sizes and the columns that it has."""

    id: str
    key_hash: str
    n_events: int
    n_pixels: int
    sample: str
    columns: tuple[str, ...]

    @classmethod
    def create(cls, spark: SparkSession, root: str, id: str, events: DataFrame, pixels: DataFrame, sample: str = "in-sample", most: int = 0) -> EvalSet:
        """Writes the set once; one that is there already, without events or with ``violations`` is an error. ``events``: event_idx,
        event_key and truth; ``pixels``: event_idx, channel, tick, charge and truth."""
        events, pixels = first_events(events, pixels, most)
        truth = [c for c in (*events.columns, *pixels.columns) if c not in ("event_idx", "event_key", "channel", "tick", "charge")]
        if bad := violations(events, pixels, truth).collect():
            raise ValueError("; ".join(f"{r['problem']} ({r['n']})" for r in bad))
        events.write.mode("error").parquet(f"{root}/events")
        pixels.write.mode("error").parquet(f"{root}/pixels")
        events, pixels = spark.read.parquet(f"{root}/events"), spark.read.parquet(f"{root}/pixels")
        digest = key_digest(events, "event_key").first()
        if not digest["n"]:
            raise ValueError("an evaluation set needs events")
        columns = (*[f"events.{c}" for c in events.columns], *[f"pixels.{c}" for c in pixels.columns])
        own = cls(id, digest["digest"], digest["n"], pixels.count(), sample, columns)
        row = [(own.id, own.key_hash, own.n_events, own.n_pixels, own.sample, list(own.columns))]
        spark.createDataFrame(row, "id string, key_hash string, n_events long, n_pixels long, sample string, columns array<string>").coalesce(1).write.mode("error").json(f"{root}/set")
        return own

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> EvalSet:
        """The descriptor of a set; a folder without one is an error."""
        try:
            row = spark.read.json(f"{root}/set").first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            raise FileNotFoundError(f"{root} has no evaluation set; create it once") from e
        return cls(row["id"], row["key_hash"], row["n_events"], row["n_pixels"], row["sample"], tuple(row["columns"]))

    def read(self, spark: SparkSession, root: str, *names: str) -> DataFrame:
        """Columns ``events.<name>`` or ``pixels.<name>`` of one of the tables with its event_idx; an unknown one is an error."""
        if missing := [n for n in names if n not in self.columns]:
            raise KeyError(f"set {self.id!r} has no {missing}; it has {list(self.columns)}")
        table = {n.split(".", 1)[0] for n in names}
        if len(table) != 1:
            raise ValueError("columns of one table at a time")
        own = [n.split(".", 1)[1] for n in names]
        return spark.read.parquet(f"{root}/{table.pop()}").select("event_idx", *[c for c in own if c != "event_idx"])

    def verify(self, spark: SparkSession, root: str) -> None:
        """Digests the stored keys again; another digest than the recorded one is an error."""
        found = key_digest(spark.read.parquet(f"{root}/events"), "event_key").first()["digest"]
        if found != self.key_hash:
            raise ValueError(f"set {self.id!r} has changed since it was created: {found[:12]} is not {self.key_hash[:12]}")


def collated(events: DataFrame, pixels: DataFrame, batch: str = "batch_id", order: str = "event_idx") -> DataFrame:
    """One row per batch of events: event_idx and event_key lists in order, ``offsets`` (from 0, one more than events), the
    pixels' ``coords`` (channel, tick) and ``charge``, event by event, and a list for every further column of ``pixels``.

    A batch is what one step takes, so its pixels make one row. An event without pixels has an empty share. A batch of which the
    offsets don't end at its pixels can't come out, as they are counted from the very lists.
    """
    extra = [c for c in pixels.columns if c not in ("event_idx", "channel", "tick", "charge")]
    lists = pixels.groupBy("event_idx").agg(F.array_sort(F.collect_list(F.struct("channel", "tick", "charge", *extra))).alias("px"))
    rows = events.select(batch, "event_idx", "event_key", F.col(order).alias("__order")).join(lists, "event_idx", "left").withColumn("px", F.coalesce("px", F.array()))
    rows = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("__order", "event_idx", "event_key", "px"))).alias("e"))
    offsets = F.aggregate("e", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.size(x["px"]))))
    rows = rows.select(batch, F.col("e.event_idx").alias("event_idx"), F.col("e.event_key").alias("event_key"), offsets.alias("offsets"), F.flatten("e.px").alias("px"))
    coords = F.transform("px", lambda p: F.struct(p["channel"].alias("channel"), p["tick"].alias("tick")))
    return rows.select(batch, "event_idx", "event_key", "offsets", coords.alias("coords"), F.col("px.charge").alias("charge"), *[F.col(f"px.{c}").alias(c) for c in extra])


# An event's truth by how it is stacked.
EVENT_STACKS = {"label": "bigint", "nu_pdg": "bigint", "nu_ccnc": "bigint", "nu_intType": "bigint", "nu_energy": "float", "vertex_xyz": "array<float>", "event_key": "string"}


def collated_meta(events: DataFrame, pixels: DataFrame | None = None, batch: str = "batch_id", order: str = "event_idx") -> DataFrame:
    """One row per batch of events with the truth that is there, event by event in order, each column in its type: whole numbers,
    energies as floats, vertices as vectors, keys; the columns of truth tiers of ``pixels`` as a list for each event, its pixels in
    the order of their coordinates as in ``collated``; and every other array column of ``events``, an event's table, as a list of lists.

    A column that neither side has is not in the result, so a reader asks for a name, not for a flag. Events without pixels have empty
    lists. Without pixels, or with none of their truth, there are no lists of theirs.
    """
    own = {c: k for c, k in EVENT_STACKS.items() if c in events.columns}
    tables = {f.name: f.dataType.simpleString() for f in events.schema if f.name not in (*own, batch, order) and f.dataType.typeName() == "array"}
    tiers = {c: k for c, k in PIXEL_TYPES.items() if pixels is not None and c in pixels.columns}
    rows = events.select(batch, F.col("event_idx").alias("__event"), F.col(order).alias("__order"), *[F.col(c).cast(k).alias(c) for c, k in {**own, **tables}.items()])
    if tiers:
        lists = pixels.groupBy(F.col("event_idx").alias("__event")).agg(F.array_sort(F.collect_list(F.struct("channel", "tick", "charge", *[F.col(c).cast(k).alias(c) for c, k in tiers.items()]))).alias("__px"))
        rows = rows.join(lists, "__event", "left").select(*rows.columns, *[F.coalesce(F.col(f"__px.{c}"), F.array().cast(f"array<{k}>")).alias(c) for c, k in tiers.items()])
    names = [*own, *tables, *tiers]
    rows = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("__order", "__event", F.struct(*names).alias("v") if names else F.lit(0).alias("v"))), lambda a, b: _by_place(a, b)).alias("e"))
    stack = lambda c: F.transform("e", lambda x: x["v"][c]).alias(c)
    return rows.select(batch, *map(stack, names))


def _by_place(a, b):
    """Two events of a batch by their order, then their number: what else they have need not be comparable."""
    return F.when(a["__order"] < b["__order"], -1).when(a["__order"] > b["__order"], 1).when(a["__event"] < b["__event"], -1).when(a["__event"] > b["__event"], 1).otherwise(0)


def require_batches(batches: DataFrame) -> DataFrame:
    """``batches`` (offsets, coords, charge); one whose lists disagree in length or whose offsets don't run from 0 to it is an error."""
    n = F.size("coords")
    sound = (F.size("charge") == n) & (F.element_at("offsets", 1) == 0) & (F.element_at("offsets", -1) == n) & (F.size("offsets") == F.size("event_idx") + 1)
    return batches.where(F.when(sound, True).otherwise(F.raise_error(F.lit("a batch's offsets and rows disagree")).cast("boolean")))


def misaligned(output: DataFrame, source: DataFrame, stride: int = 1) -> DataFrame:
    """What a backbone changed: at stride 1 rows (event_idx, channel, tick, pos, side) that only one side has; above it events
    (event_idx, found, expected) that have another number of rows than the source's cells of that width."""
    if stride == 1:
        keys = ["event_idx", "channel", "tick", "pos"]
        a, b = output.select(*keys), source.select(*keys)
        return a.exceptAll(b).withColumn("side", F.lit("output")).unionByName(b.exceptAll(a).withColumn("side", F.lit("source")))
    found = output.groupBy("event_idx").agg(F.count(F.lit(1)).alias("found"))
    cells = source.select("event_idx", F.floor(F.col("channel") / stride).alias("x"), F.floor(F.col("tick") / stride).alias("y")).distinct()
    expected = cells.groupBy("event_idx").agg(F.count(F.lit(1)).alias("expected"))
    both = found.join(expected, "event_idx", "full").na.fill(0, ["found", "expected"])
    return both.where("found <> expected")


def require_aligned(output: DataFrame, source: DataFrame, stride: int = 1) -> None:
    """An error if ``misaligned`` finds anything."""
    bad = misaligned(output, source, stride)
    if not bad.isEmpty():
        raise RuntimeError(f"rows of the output are not those of the source at stride {stride}, for example {bad.first().asDict()}")


def numbered(pixels: DataFrame) -> DataFrame:
    """``pixels`` with ``pos``, the place of a pixel in its event by channel and tick."""
    return pixels.withColumn("pos", F.row_number().over(Window.partitionBy("event_idx").orderBy("channel", "tick")) - 1)
