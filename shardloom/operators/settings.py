"""Schemas of settings, and what stored settings have against them."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections by name: their keys with types (long, double, boolean, string or list), and the keys that must be there.
_SECTIONS: dict[str, tuple[dict[str, str], set[str]]] = {}
# Python's types and the names above.
KINDS = {"int": "long", "float": "double", "bool": "boolean", "str": "string"}


def register(section: str, keys: dict[str, str] | type, required: tuple[str, ...] = ()) -> None:
    """Makes a section known: its keys and types, or a dataclass that has them. Another schema under a known name is an error."""
    if is_dataclass(keys):
        kind = lambda t: KINDS.get(t if isinstance(t, str) else t.__name__, "list" if "tuple" in str(t) or "list" in str(t) else "string")
        keys = {f.name: kind(f.type) for f in fields(keys)}
    if _SECTIONS.get(section, (keys, set(required))) != (keys, set(required)):
        raise ValueError(f"section {section!r} has another schema already")
    _SECTIONS[section] = (keys, set(required))


def register_framework() -> list[str]:
    """Registers the library's own sections and gives their names; doing it again changes nothing."""
    from shardloom.operators.pools import PoolSpec

    register("pools", PoolSpec)
    register("data", {"backend": "string", "path": "string", "events": "string", "pixel": "boolean", "extra": "boolean", "rich": "boolean"}, ("backend", "path"))
    register("loader", {"size": "long", "seed": "long", "readers": "long", "drop_last": "boolean"}, ("size",))
    register("schedule", {"base": "double", "final": "double", "total": "long", "warmup": "long", "start": "double", "freeze": "long"}, ("base", "total"))
    return sorted(_SECTIONS)


def schema(spark: SparkSession) -> DataFrame:
    """(section, key, kind, required) of all sections."""
    rows = [(s, k, kind, k in required) for s, (keys, required) in sorted(_SECTIONS.items()) for k, kind in keys.items()]
    return spark.createDataFrame(rows, "section string, key string, kind string, required boolean")


def violations(settings: DataFrame, schema: DataFrame) -> DataFrame:
    """(run, section, key, problem) of settings (run, section, key, value as text): 'unknown section', 'unknown key', 'not a <kind>' or 'missing'.

    A null value is not there. Lists are JSON. The schema is broadcast: it has a row for each key that code has registered.
    """
    known = F.broadcast(schema.select("section", "key", "kind", F.lit(True).alias("known")))
    sections = F.broadcast(schema.select("section", F.lit(True).alias("has")).distinct())
    rows = settings.where("value is not null").join(sections, "section", "left").join(known, ["section", "key"], "left")
    text = F.lower("value")
    fits = (
        F.when(F.col("kind") == "long", F.col("value").rlike("^[+-]?[0-9]+$"))
        .when(F.col("kind") == "double", F.col("value").try_cast("double").isNotNull())
        .when(F.col("kind") == "boolean", text.isin("true", "false"))
        .when(F.col("kind") == "list", F.col("value").rlike(r"^\s*\[.*\]\s*$"))
        .otherwise(True)
    )
    problem = F.when(F.col("has").isNull(), "unknown section").when(F.col("known").isNull(), "unknown key").when(~fits, F.concat(F.lit("not a "), "kind"))
    wrong = rows.select("run", "section", "key", problem.alias("problem")).where("problem is not null")
    begun = settings.select("run", "section").distinct()
    needed = begun.join(F.broadcast(schema.where("required").select("section", "key")), "section")
    lost = needed.join(settings.where("value is not null").select("run", "section", "key"), ["run", "section", "key"], "left_anti")
    return wrong.unionByName(lost.select("run", "section", "key", F.lit("missing").alias("problem")))
