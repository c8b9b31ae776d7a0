"""The object-graph model on the test tables.

Blobs are the texts of documents, staged as `<source>/<lang>/doc<doc_id>`; commits are events, each with the
event before of the same user as parent; a second graph, with shared nodes, leads from regions over nations, customers and
orders to parts and suppliers. References name the newest event of each user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import objects as O
from ..runtime import table


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, lang, oid, size)."""
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", "source", "lang", O.blob_id(text).alias("oid"), F.octet_length(text).cast("long").alias("size"))


def staged(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return blobs(spark, sf).select(path.alias("path"), F.lit("100644").alias("perm"), F.col("oid").alias("node"))


def star(spark: SparkSession, sf: str, repeats: bool = False) -> DataFrame:
    """Edges (src, dst, kind); with repeats, those of lines as often as there are such lines, which does no harm to a walk and needs no shuffle."""
    t = lambda n: table(spark, sf, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))
    lines = lambda *c: t("lineitem").select(*c) if repeats else t("lineitem").select(*c).distinct()
    return (
        edge(t("nation"), key("r", "n_regionkey"), key("n", "n_nationkey"), "nation")
        .unionAll(edge(t("customer"), key("n", "c_nationkey"), key("c", "c_custkey"), "customer"))
        .unionAll(edge(t("orders"), key("c", "o_custkey"), key("o", "o_orderkey"), "order"))
        .unionAll(edge(lines("l_orderkey", "l_partkey"), key("o", "l_orderkey"), key("p", "l_partkey"), "part"))
        .unionAll(edge(lines("l_orderkey", "l_suppkey"), key("o", "l_orderkey"), key("s", "l_suppkey"), "supplier"))
    )


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """(node, parent, ts, user_id, event_type)."""
    events = table(spark, sf, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    name = lambda c: F.when(c.isNotNull(), F.concat(F.lit("e"), c.cast("string")))
    ts = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return events.select(name(F.col("event_id")).alias("node"), name(before).alias("parent"), ts.alias("ts"), "user_id", "event_type")


def heads(spark: SparkSession, sf: str) -> DataFrame:
    """(name, oid): for each user the newest event."""
    last = F.max_by(F.concat(F.lit("e"), F.col("event_id").cast("string")), F.struct("ts", "event_id"))
    return table(spark, sf, "events").groupBy("user_id").agg(last.alias("oid")).select(F.concat(F.lit("refs/heads/u"), F.col("user_id").cast("string")).alias("name"), "oid")


def symbolic(spark: SparkSession, sf: str) -> DataFrame:
    """(name, oid, ref): customers point at the customer of half their number, nations in a circle, regions nowhere; heads hold ids."""
    none = F.lit(None).cast("string")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    half = F.floor(F.col("k") / 2).cast("long")
    chain = c.select(name("refs/alias/c", F.col("k")).alias("name"), F.when(F.col("k") <= 1, F.lit("e1")).alias("oid"), F.when(F.col("k") > 1, name("refs/alias/c", half)).alias("ref"))
    n = F.col("n_nationkey")
    circle = table(spark, sf, "nation").select(name("refs/cycle/n", n).alias("name"), none.alias("oid"), name("refs/cycle/n", (n + 1) % 25).alias("ref"))
    lost = table(spark, sf, "region").select(name("refs/lost/r", F.col("r_regionkey")).alias("name"), none.alias("oid"), name("refs/none/r", F.col("r_regionkey")).alias("ref"))
    return heads(spark, sf).select("name", "oid", none.alias("ref")).unionAll(chain).unionAll(circle).unionAll(lost)
