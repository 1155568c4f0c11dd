"""The wiring of a detector from its nested JSON store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = (
    "Store struct<anodes: array<struct<Anode: struct<faces: array<int>>>>, faces: array<struct<Face: struct<planes: array<int>>>>, "
    "planes: array<struct<Plane: struct<wires: array<int>>>>, wires: array<struct<Wire: struct<channel: int, head: int, tail: int>>>, "
    "points: array<struct<Point: struct<x: double, y: double, z: double>>>>"
)


def read_wires(spark: SparkSession, path: str) -> DataFrame:
    """(anode, face, plane, seg_pos, channel, head, tail) of a store, which may be bz2-compressed; ends in its unit, mm.

    The store refers by position: anodes to faces, faces to planes, planes to wires, wires to points; each list becomes
    a table of its own and the references are joins.
    """
    store = spark.read.schema(STORE).option("multiLine", True).json(path).select("Store.*")
    table = lambda name, item: store.select(F.posexplode(name).alias(f"{item}_id", "v")).select(f"{item}_id", f"v.{item}.*")
    anodes, faces, planes, wires, points = (table(n, i) for n, i in (("anodes", "Anode"), ("faces", "Face"), ("planes", "Plane"), ("wires", "Wire"), ("points", "Point")))
    rows = anodes.select(F.col("Anode_id").alias("anode"), F.posexplode("faces").alias("face", "Face_id"))
    rows = rows.join(faces, "Face_id").select("anode", "face", F.posexplode("planes").alias("plane", "Plane_id"))
    rows = rows.join(planes, "Plane_id").select("anode", "face", "plane", F.posexplode("wires").alias("seg_pos", "Wire_id"))
    end = lambda name: points.select(F.col("Point_id").alias(name), F.struct("x", "y", "z").alias(f"{name}_at"))
    rows = rows.join(wires, "Wire_id").join(end("head"), "head").join(end("tail"), "tail")
    return rows.select("anode", "face", "plane", "seg_pos", "channel", F.col("head_at").alias("head"), F.col("tail_at").alias("tail"))


def cached_wires(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """``read_wires``, from a table that is written once below ``cache``: its name has the store's size and time, so that a store that
    changed is read anew. Of several jobs that write it at once one does; a half-written table is not taken, as it lacks its mark."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    store = jvm.org.apache.hadoop.fs.Path(path)
    status = store.getFileSystem(conf).getFileStatus(store)
    table = f"{cache}/{store.getName()}-{status.getLen()}-{status.getModificationTime()}"
    done = jvm.org.apache.hadoop.fs.Path(f"{table}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        aside = f"{table}-{uuid.uuid4().hex}"
        read_wires(spark, path).write.parquet(aside)
        system, to = done.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(table)
        if system.exists(to) or not system.rename(jvm.org.apache.hadoop.fs.Path(aside), to):
            system.delete(jvm.org.apache.hadoop.fs.Path(aside), True)
    return spark.read.parquet(table)
