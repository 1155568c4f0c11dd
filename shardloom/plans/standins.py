"""The driver's tables as events, pixels, features and logs, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdg = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 14 WHEN '2-HIGH' THEN -14 WHEN '3-MEDIUM' THEN 12 WHEN '4-NOT SPECIFIED' THEN 16 ELSE -12 END")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_idx"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("event_key"), pdg.alias("nu_pdg"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END").alias("nu_ccnc"), F.col("o_totalprice").alias("nu_energy"),
    )


EVENTS = """ev AS (SELECT o_orderkey AS event_idx, 'o' || o_orderkey AS event_key,
  CASE o_orderpriority WHEN '1-URGENT' THEN 14 WHEN '2-HIGH' THEN -14 WHEN '3-MEDIUM' THEN 12 WHEN '4-NOT SPECIFIED' THEN 16 ELSE -12 END AS nu_pdg,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS nu_ccnc, o_totalprice AS nu_energy FROM orders)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS event_idx", "l_partkey AS channel", "l_suppkey AS tick", "l_extendedprice AS charge",
        "CASE WHEN l_quantity <= 5 THEN 0 ELSE CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END + CASE WHEN l_linestatus = 'O' THEN 3 ELSE 0 END END AS label",
        "1 - l_discount * 5 AS energyfrac", "l_suppkey - 50 AS trackid", "l_linenumber AS line",
        "(l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey AS pixel_idx",
    )


PIXELS = """px AS (SELECT l_orderkey AS event_idx, l_partkey AS channel, l_suppkey AS tick, l_extendedprice AS charge,
  CASE WHEN l_quantity <= 5 THEN 0 ELSE CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END + CASE WHEN l_linestatus = 'O' THEN 3 ELSE 0 END END AS label,
  1 - l_discount * 5 AS energyfrac, l_suppkey - 50 AS trackid, l_linenumber AS line, (l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey AS pixel_idx FROM lineitem)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


FEATURES = """ft AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metrics log in long form: run, key, step, value."""
    rows = table(spark, sf_dir, "events")
    return rows.selectExpr("user_id AS run", "event_type AS key", "event_id AS step", "value", "props")


LOG = "lg AS (SELECT user_id AS run, event_type AS key, event_id AS step, value, props FROM events)"


def labels_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result labels <run>_seed<k>:ep<n>:<source>, with a metric."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('run', s_nationkey, '_seed', s_suppkey % 3, ':ep', s_suppkey % 7, ':', CASE WHEN s_suppkey % 2 = 0 THEN 'student' ELSE 'teacher' END) AS label",
        "s_acctbal AS score", "concat('set', s_nationkey % 2) AS eval_set_id", "s_suppkey AS n",
    )


RUN_LABELS = """rl AS (SELECT 'run' || s_nationkey || '_seed' || s_suppkey % 3 || ':ep' || s_suppkey % 7 || ':' || CASE WHEN s_suppkey % 2 = 0 THEN 'student' ELSE 'teacher' END AS label,
  s_acctbal AS score, 'set' || s_nationkey % 2 AS eval_set_id, s_suppkey AS n FROM supplier)"""
