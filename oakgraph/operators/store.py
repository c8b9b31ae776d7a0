"""Reads and writes of the content-addressed table: objects(oid, kind, size, raw)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import objects as O


def objects_of(payloads: DataFrame, kind: str, payload: Column) -> DataFrame:
    """(oid, kind, size, raw) of payloads of one kind, each content once."""
    rows = payloads.select(payload.alias("raw")).select(O.object_id(kind, F.col("raw")).alias("oid"), F.lit(kind).alias("kind"), F.octet_length("raw").cast("long").alias("size"), "raw")
    return rows.dropDuplicates(["oid"])


def tiers(*layers: DataFrame) -> DataFrame:
    """The union of layers, in which the first layer that has an id wins."""
    all_rows = None
    for i, layer in enumerate(layers):
        one = layer.withColumn("tier", F.lit(i))
        all_rows = one if all_rows is None else all_rows.unionByName(one)
    best = F.min_by(F.struct(*layers[0].columns), F.col("tier")).alias("o")
    return all_rows.groupBy("oid").agg(best).select("o.*")


def read(objects: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """wanted (oid) with the kind, size and raw found; missing ones have nulls, or raise if strict."""
    found = wanted.join(objects, "oid", "left")
    if strict:
        found = found.withColumn("kind", F.when(F.col("kind").isNull(), F.raise_error(F.concat(F.lit("no object "), "oid"))).otherwise(F.col("kind")))
    return found


def exists(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (oid, other columns) with the column present, a row for each row of wanted."""
    have = objects.select(F.col("oid").alias("have")).distinct()
    return wanted.join(have, F.col("oid") == F.col("have"), "left").select(*[wanted[c] for c in wanted.columns], F.col("have").isNotNull().alias("present"))


def append(objects: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new that are to be written: those whose id is not there yet, each once."""
    return new.dropDuplicates(["oid"]).join(objects.select("oid"), "oid", "left_anti")


def pack_index(objects: DataFrame) -> DataFrame:
    """(oid, offset, crc, fanout): where objects lie when stored in the order of their ids; fanout is the first byte.

    Offsets are running sums, taken within the first two bytes and over the 65,536 totals at most, so no window holds all rows.
    """
    rows = objects.select("oid", "size", F.crc32("raw").alias("crc"), O.id_byte(F.col("oid"), 0).alias("fanout"), F.substring("oid", 1, 4).alias("part"))
    totals = rows.groupBy("part").agg(F.sum("size").alias("held"))
    base = totals.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("oid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inner", inner).join(F.broadcast(base), "part").select("oid", (F.col("base") + F.col("inner")).cast("long").alias("offset"), "crc", "fanout")


def fanout(objects: DataFrame) -> DataFrame:
    """(fanout, n, upto): ids by first byte, and how many have this one or a smaller one."""
    rows = objects.groupBy(O.id_byte(F.col("oid"), 0).alias("fanout")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("upto", F.sum("n").over(Window.orderBy("fanout")))
