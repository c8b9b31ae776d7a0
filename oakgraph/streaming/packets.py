"""Packets: framing, channels, and replays as Structured Streaming.

A packet is four hex digits, the length with these, and the body; `0000` is a flush. On a multiplexed stream the first byte of
the body is its channel: 1 data, 2 progress, 3 errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import refs
from ..runtime import empty, work_path

CHANNELS = {1: "data", 2: "progress", 3: "error"}


def frame(body: Column) -> Column:
    """A packet as BINARY; a null body gives a flush."""
    size = F.lpad(F.lower(F.hex(F.octet_length(body) + 4)), 4, "0")
    return F.coalesce(F.concat(F.encode(size, "UTF-8"), body), F.lit(b"0000"))


def unframe(packet: Column) -> Column:
    """The body; null for a flush, and an error if the length is wrong."""
    size = F.conv(F.decode(F.substring(packet, 1, 4), "ISO-8859-1"), 16, 10).cast("int")
    wrong = F.raise_error(F.concat(F.lit("a packet of another length than "), size.cast("string"))).cast("binary")
    return F.when(size == 0, F.lit(None).cast("binary")).when(size == F.octet_length(packet), F.substring(packet, 5, F.octet_length(packet))).otherwise(wrong)


def demultiplex(packets: DataFrame) -> DataFrame:
    """packets (..., packet) with channel and payload for packet; flushes are left out. For tables and streams alike."""
    body = packets.withColumn("body", unframe(F.col("packet"))).where("body is not null")
    channel = F.conv(F.hex(F.substring("body", 1, 1)), 16, 10).cast("int")
    return body.withColumn("channel", channel).withColumn("payload", F.substring("body", 2, F.octet_length("body"))).drop("packet", "body")


def message(line: Column) -> Column:
    """STRUCT of type, oid and detail of a line of an exchange: want, have, shallow, unshallow, deepen, ack, nak, done, unpack, ok, ng,
    or a command (create, update, delete; oid is the new id, or the old one of what goes); null if it is none of these."""
    head, rest = F.substring_index(line, " ", 1), F.regexp_extract(line, r"^\S+ (.*)$", 1)
    zeros = "0" * 40
    command = r"^([0-9a-f]{40}) ([0-9a-f]{40}) (\S+)$"
    old, new, name = (F.regexp_extract(line, command, i) for i in (1, 2, 3))
    none = F.lit(None).cast("string")
    row = lambda kind, oid, detail: F.struct(kind.alias("type"), oid.alias("oid"), detail.alias("detail"))
    after = lambda c: F.nullif(F.regexp_extract(c, r"^\S+ (.*)$", 1), F.lit(""))
    return (
        F.when(head.isin("want", "have", "shallow", "unshallow"), row(head, F.substring_index(rest, " ", 1), after(rest)))
        .when(head == "ACK", row(F.lit("ack"), F.substring_index(rest, " ", 1), after(rest)))
        .when(head == "NAK", row(F.lit("nak"), none, none))
        .when(head == "done", row(head, none, none))
        .when(head.isin("deepen", "unpack", "ok", "ng"), row(head, none, rest))
        .when(line.rlike(command), row(F.when(old == zeros, F.lit("create")).when(new == zeros, F.lit("delete")).otherwise(F.lit("update")), F.when(new == zeros, old).otherwise(new), name))
    )


def line_of(kind: Column, oid: Column, detail: Column, old: Column | None = None) -> Column:
    """The line of a message, as message() takes it apart; old: the id before an update. Null for a flush."""
    zeros = F.lit("0" * 40)
    more = F.coalesce(F.concat(F.lit(" "), F.nullif(detail, F.lit(""))), F.lit(""))
    text = (
        F.when(kind.isin("want", "have", "shallow", "unshallow"), F.concat(kind, F.lit(" "), oid, more))
        .when(kind == "ack", F.concat(F.lit("ACK "), oid, more))
        .when(kind == "nak", F.lit("NAK"))
        .when(kind == "done", kind)
        .when(kind.isin("deepen", "unpack", "ok", "ng"), F.concat(kind, more))
    )
    command = F.when(kind == "create", F.concat_ws(" ", zeros, oid, detail)).when(kind == "delete", F.concat_ws(" ", oid, zeros, detail))
    if old is not None:
        command = command.when(kind == "update", F.concat_ws(" ", old, oid, detail))
    return F.when(kind == "flush", F.lit(None).cast("string")).otherwise(F.coalesce(F.concat(text, F.lit("\n")), command, F.raise_error(F.concat(F.lit("no line for "), kind)).cast("string")))


def encode_messages(rows: DataFrame) -> DataFrame:
    """rows (..., type, oid, detail, and old if there are updates) with packet for these; decode_messages() turns it around."""
    old = F.col("old") if "old" in rows.columns else None
    packet = frame(F.encode(line_of(F.col("type"), F.col("oid"), F.col("detail"), old), "UTF-8"))
    return rows.withColumn("packet", packet).drop("type", "oid", "detail", "old")


def decode_messages(packets: DataFrame) -> DataFrame:
    """packets (..., packet) with type, oid and detail for packet; flushes have the type flush."""
    line = F.regexp_replace(F.decode(unframe(F.col("packet")), "UTF-8"), "\n$", "")
    rows = packets.withColumn("line", line).withColumn("m", F.coalesce(message(F.col("line")), F.when(F.col("line").isNull(), F.struct(F.lit("flush").alias("type"), F.lit(None).cast("string").alias("oid"), F.lit(None).cast("string").alias("detail")))))
    return rows.select(*[c for c in packets.columns if c != "packet"], "m.type", "m.oid", "m.detail")


def decode_advertised(packets: DataFrame) -> DataFrame:
    """(name, oid, peeled) of packets (packet) with `<id> <name>`, capabilities after a NUL left out; peeled names end in `^{}`."""
    line = F.regexp_replace(F.substring_index(F.decode(unframe(F.col("packet")), "UTF-8"), "\x00", 1), "\n$", "")
    rows = packets.select(line.alias("line")).where("line is not null")
    name = F.regexp_extract("line", r"^\S+ (.*)$", 1)
    return rows.select(F.regexp_replace(name, r"\^\{\}$", "").alias("name"), F.substring_index("line", " ", 1).alias("oid"), F.endswith(name, F.lit("^{}")).alias("peeled"))


def replay_refs(spark: SparkSession, source: str, files_per_batch: int = 2) -> DataFrame:
    """References after a stream of write files (name, oid, seq), applied batch by batch.

    The last write of each name is kept with its sequence, deletions included, so batches may come in any order. States are
    written side by side below the shared folder, under the batch's number: a batch that runs again writes the same state.
    """
    schema = spark.read.parquet(source).schema
    state = work_path(spark, "ref-state")

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.select("name", "oid", "seq")
        if number:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{state}/{number - 1}"))
        rows.groupBy("name").agg(F.max_by(F.struct("oid", "seq"), F.struct("seq", "oid")).alias("w")).select("name", "w.*").write.mode("overwrite").parquet(f"{state}/{number}")
        last.append(number)

    last: list[int] = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    run = stream.writeStream.foreachBatch(apply).option("checkpointLocation", work_path(spark, "ref-stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    if not last:
        return empty(spark, "name string, oid string")
    return refs.upsert(empty(spark, "name string, oid string"), spark.read.parquet(f"{state}/{max(last)}"))
