"""The populations that probes are scored on: drawn once, by seeded order, from pixels with truth; never redrawn by a reader."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.expressions import contamination, has_instance, md5_order
from shardloom.operators import sampling
from shardloom.operators.grouped import if_few
from shardloom.sources.tables import cut

#: Classes of pixel labels that the particle probe tells apart.
PID_CLASSES = (1, 2, 3, 4, 5, 6)


@dataclass
class PoolSpec:
    """What pools are drawn with; ``notes`` says why one is absent."""

    seed: int = 42
    per_class: int = 10_000
    train_frac: float = 0.8
    overlap_thresholds: tuple[float, ...] = (0.2, 0.1, 0.3)
    overlap_train_per_class: int = 20_000
    overlap_val_pixels: int = 2_000_000
    vertex_radii_px: tuple[float, ...] = (20.0, 10.0, 30.0)
    vertex_train_per_class: int = 50_000
    vertex_val_pixels: int = 200_000
    instance_max_queries: int = 100_000
    event_max_per_event: int = 2_000
    knn_max_per_class: int = 10_000
    knn_max_per_image: int = 0
    notes: dict[str, str] = field(default_factory=dict)

    def as_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, values: dict) -> PoolSpec:
        """The spec of stored values; unknown ones are left out."""
        own = {f.name for f in fields(cls)}
        return cls(**{k: tuple(map(float, v)) if isinstance(v, list) else v for k, v in values.items() if k in own})

    def check(self, probe: str, **expected) -> None:
        """Refuses pools that were drawn with other constants than the probe is written for."""
        plain = lambda v: tuple(map(float, v)) if isinstance(v, tuple | list) else v
        if wrong := {k: v for k, v in expected.items() if plain(getattr(self, k)) != plain(v)}:
            raise ValueError(f"{probe}: the pools were drawn with {({k: getattr(self, k) for k in wrong})}, not with {wrong}; draw them anew")


def draw_pools(pixels: DataFrame, events: DataFrame, spec: PoolSpec, key: str = "pixel_idx") -> DataFrame:
    """(pool, key) of every pool that the truth in ``pixels`` allows, one table; ``spec.notes`` gets a line for each that is absent.

    ``pixels``: event_idx, the key, and as far as known ``label``, ``energyfrac``, ``trackid`` and ``distance`` (to the vertex, null
    where there is none). Training and validation part by event. Training pools hold as many pixels of each class,
    validation pools follow the natural shares, except those of the particle probe. All of these are drawn together, in two passes
    over the pixels and without sorting them, see ``sampling.draws``; the pools that take some pixels of every event rank an event's pixels.
    """
    if "label" not in pixels.columns:
        spec.notes["all"] = "no labels of pixels"
        return pixels.select(F.lit("").alias("pool"), key).limit(0)
    pixels = pixels.select(*[c for c in pixels.columns if c in ("event_idx", key, "label", "energyfrac", "trackid", "distance")])
    rows = pixels.join(if_few(sampling.event_split(events, spec.seed, spec.train_frac)), "event_idx", "left")
    train, val = F.coalesce("is_train", F.lit(False)), F.coalesce(~F.col("is_train"), F.lit(False))
    order, labelled = md5_order(spec.seed, F.col(key)), F.col("label") != 0
    known = F.col("label").isin(*PID_CLASSES)
    wanted = [
        sampling.Draw("pid_train", spec.per_class, order, train & known, F.col("label")),
        sampling.Draw("pid_val", spec.per_class, md5_order(spec.seed + 1, F.col(key)), val & known, F.col("label")),
    ]
    if "energyfrac" in pixels.columns:
        share = contamination(F.col("label"), F.col("energyfrac"))
        wanted.append(sampling.Draw("overlap_val", spec.overlap_val_pixels, order, val & labelled))
        wanted += [sampling.Draw(f"overlap_train_{i}", spec.overlap_train_per_class, order, train & labelled, share > t) for i, t in enumerate(spec.overlap_thresholds)]
    else:
        spec.notes["overlap"] = "no energy fractions: contamination is unknown"
    if "trackid" in pixels.columns:
        wanted.append(sampling.Draw("instance_queries", spec.instance_max_queries, order, has_instance(F.col("label"), F.col("trackid"))))
    else:
        spec.notes["instance"] = "no track ids"
    if "distance" in pixels.columns:
        away = F.col("distance")
        wanted.append(sampling.Draw("vertex_val", spec.vertex_val_pixels, order, val & away.isNotNull()))
        wanted += [sampling.Draw(f"vertex_train_{i}", spec.vertex_train_per_class, order, train & away.isNotNull(), away <= r) for i, r in enumerate(spec.vertex_radii_px)]
    else:
        spec.notes["vertex"] = "no distances to the vertex"
    drawn = cut(sampling.draws(rows, wanted, [key]).select(F.col("draw").alias("pool"), key, "event_idx"))
    out = [drawn.select("pool", key)]
    add = lambda name, found: out.append(found.select(F.lit(name).alias("pool"), key))
    cap = spec.knn_max_per_image or sampling.image_cap(spec.knn_max_per_class, events.count())
    add("knn_pool", sampling.quota_pool(pixels, spec.knn_max_per_class, cap, spec.seed, key))
    add("event_sample", sampling.per_event(pixels, ["event_idx"], spec.event_max_per_event, spec.seed, key))
    if "trackid" in pixels.columns:
        asked = if_few(drawn.where("pool = 'instance_queries'").select("event_idx").distinct())
        add("instance_event_rows", pixels.where(has_instance(F.col("label"), F.col("trackid"))).join(asked, "event_idx", "left_semi"))
    return reduce(DataFrame.unionByName, out)


def row_space(pools: DataFrame, key: str = "pixel_idx") -> DataFrame:
    """(row_idx, key): the rows of all pools, numbered in order, but for the event sample's, which are only pooled by event."""
    return sampling.row_space(pools.where("pool <> 'event_sample'"), key)


def pool(pools: DataFrame, name: str) -> DataFrame:
    """The rows of a drawn pool; one that was not drawn is an error, not a reason to draw it."""
    found = pools.where(F.col("pool") == name)
    if found.isEmpty():
        drawn = sorted(r[0] for r in pools.select("pool").distinct().collect())  # a name per pool
        raise KeyError(f"no pool {name!r}; drawn are {', '.join(drawn)}")
    return found.drop("pool")
