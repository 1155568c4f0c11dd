"""User-defined metrics: collectors with a cadence, what they need, and how their keys are reduced over readers."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KNOWN: dict[str, type[Collector]] = {}

#: A row of what a step hands to collectors.
STEP = T.StructType(
    [T.StructField("step", T.LongType(), False), T.StructField("epoch", T.LongType(), False), T.StructField("end_of_epoch", T.BooleanType(), False), T.StructField("key", T.StringType(), False), T.StructField("value", T.DoubleType())]
)


@dataclass
class Collector:
    """``compute`` gets the rows of a step as a frame and gives values by key; ``cadence`` is 'step', 'epoch' or a number of steps."""

    cadence: str | int = "step"
    needs: tuple[str, ...] = ()
    reduce: dict[str, str] = field(default_factory=dict)

    def compute(self, rows: pd.DataFrame) -> dict[str, float]:
        raise NotImplementedError

    def unmet(self, columns: list[str]) -> set[str]:
        return set(self.needs) - set(columns)

    def fires(self, step: int, end_of_epoch: bool = False) -> bool:
        if isinstance(self.cadence, str):
            return self.cadence == "step" or end_of_epoch
        return self.cadence > 0 and step % self.cadence == 0


def register(name: str):
    """Makes a collector known by name."""

    def add(kind: type[Collector]) -> type[Collector]:
        _KNOWN[name] = kind
        return kind

    return add


def load_plugins(group: str = "shardloom.collectors") -> list[str]:
    """Registers the collectors that installed packages offer as entry points of ``group``; returns their names. One that can't be loaded is
    left out with a warning. A name that is known already for another class is an error."""
    import warnings
    from importlib.metadata import entry_points

    names = []
    for point in entry_points(group=group):
        try:
            kind = point.load()
        except Exception as e:  # noqa: BLE001 - one broken package doesn't take the others with it
            warnings.warn(f"collector {point.name!r} can't be loaded: {type(e).__name__}: {e}", stacklevel=2)
            continue
        if _KNOWN.get(point.name, kind) is not kind:
            raise ValueError(f"two collectors are called {point.name!r}")
        _KNOWN[point.name] = kind
        names.append(point.name)
    return names


def build(config: dict[str, dict]) -> dict[str, Collector]:
    """Collectors by name from their settings; an unknown one is an error."""
    if unknown := set(config) - set(_KNOWN):
        raise ValueError(f"unknown collectors: {', '.join(sorted(unknown))}")
    return {name: _KNOWN[name](**settings) for name, settings in config.items()}


def step_rows(log: DataFrame, epoch_length: int) -> DataFrame:
    """Rows of STEP from a log's lines (JSON objects with ``step``): one for each number in a record, with the epoch that the step is of
    and whether it is its last. Records without a step, and values that are no numbers, give none."""
    values = F.from_json("line", "map<string, string>")
    rows = log.select(F.get_json_object("line", "$.step").try_cast("long").alias("step"), F.explode(values).alias("key", "text")).where("step is not null and key <> 'step'")
    rows = rows.withColumn("value", F.col("text").try_cast("double")).where("value is not null")
    rows = rows.select("step", F.floor(F.col("step") / epoch_length).alias("epoch"), ((F.col("step") + 1) % epoch_length == 0).alias("end_of_epoch"), "key", "value")
    return rows.to(T.StructType([T.StructField(f.name, f.dataType) for f in STEP]))


def collect(rows: DataFrame, collectors: dict[str, Collector], step: str = "step") -> DataFrame:
    """(step, key, value) of the collectors due at each step; keys are ``<collector>/<key>``. One with unmet needs gives nothing."""
    own = {n: c for n, c in collectors.items() if not c.unmet(rows.columns)}
    last = rows.agg(F.max(step)).first()[0] if any(c.cadence == "epoch" for c in own.values()) else None

    def compute(part: pd.DataFrame) -> pd.DataFrame:
        at = int(part[step].iloc[0])
        found = [(at, f"{n}/{k}", float(v)) for n, c in own.items() if c.fires(at, at == last) for k, v in c.compute(part).items()]
        return pd.DataFrame(found, columns=["step", "key", "value"])

    return rows.groupBy(step).applyInPandas(compute, "step long, key string, value double")
