"""Substring dedup with content-defined chunks.

A gear hash of the last WINDOW bytes rolls over each text, and a chunk ends where the hash is the least within REACH bytes on
either side. So borders depend on the bytes around them alone: an insertion moves only the chunks near it, and two texts with
a passage in common fall into step at its first border. Chunks are matched by a 128-bit
digest over the whole corpus. A chunk counts as repeated where it lies in a run of chunks, each found more than
once, of MIN_RUN bytes or more, or, with short_copies, where its whole text is a copy of any length (texts below MIN_RUN are one
chunk); shorter coincidences are left alone. Of each repeated chunk the occurrence with
the smallest (id, offset) stays and the others go.

Offsets are in bytes of the UTF-8 text, and borders never cut a character. The chunks are written once. Digests are counted with
map-side aggregation and only repeated ones are joined back; those found very often are broadcast, so a passage in a third of all
documents stays where it is, and no task holds all occurrences of a chunk.

Defined cases: a null or empty text has no chunks and zeros; in a text that repeats itself at less than REACH bytes a chunk ends at
the first of the equal minima after MIN_CHUNK bytes, so that chunks hold whole periods; a very long text is a slice of its own;
repeated rows are copies of each other; rows that
share an id are taken as one document, whose chunks at the same offset and digest count once; a null id sorts
first; an empty table gives an empty result; other columns are left out, or kept unchanged by remove_repeats().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize
from .common import attach, id_text_slices, row_slices, unused

WINDOW = 16
REACH = 24
MIN_CHUNK, MAX_CHUNK = 24, 128
MIN_RUN = 128
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, np.uint16)
NONE = np.uint16(0xFFFF)


def least_within(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[:n], x[width - size :][:n])


def candidates(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in all texts, set apart by REACH zero bytes, after which a border is asked for; and where the texts begin."""
    gap = bytes(REACH)
    starts = np.cumsum([REACH, *(len(t) + REACH for t in texts)])[:-1]
    data = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    hashed, gears = np.zeros(len(data), np.uint16), GEAR[data]
    for j in range(min(WINDOW, len(data))):
        hashed[j:] += gears[: len(data) - j] << np.uint16(j)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[starts + [len(t) for t in texts]] -= 1
    hashed[np.cumsum(inside[:-1]) == 0] = NONE
    own = hashed[REACH : len(data) - REACH]
    return np.flatnonzero((own == least_within(hashed, 2 * REACH + 1)) & (own < NONE)) + REACH + 1, starts


def borders(wanted: list[int], size: int, data: bytes) -> list[int]:
    """Ends of the chunks of one text, from its candidate offsets."""
    ends, start = [], 0

    def close(at: int) -> int:
        while at < size and 0x80 <= data[at] < 0xC0:  # inside a character
            at += 1
        ends.append(at)
        return at

    for at in [*wanted, size]:
        while at - start > MAX_CHUNK:
            start = close(start + MAX_CHUNK)
        if at - start >= MIN_CHUNK and at < size:
            start = close(at)
    if start < size:
        ends.append(size)
    return ends


def split(texts: list[str]) -> Iterator[tuple[bytes, list[int]]]:
    """Each text's bytes and the ends of its chunks; a text below MIN_RUN bytes is one chunk."""
    encoded = [t.encode() for t in texts]
    cuts, starts = candidates(encoded)
    sizes = np.array([len(t) for t in encoded], np.int64)
    first, last = np.searchsorted(cuts, starts, "right").tolist(), np.searchsorted(cuts, starts + sizes, "right").tolist()
    for raw, base, a, b in zip(encoded, starts.tolist(), first, last, strict=True):
        yield raw, borders((cuts[a:b] - base).tolist(), len(raw), raw) if len(raw) >= MIN_RUN else [len(raw)] * (len(raw) > 0)


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start int, size int, whole boolean, high long, low long), a row for each chunk of each whole text: the halves of its digest,
    and whether it is all of a text below MIN_RUN bytes. A written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in id_text_slices(batches):
            digests, counts, ends, whole = [], [], [], []
            for raw, own in split(texts):
                digests += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip([0, *own], own, strict=False)]
                counts.append(len(own))
                ends.append(np.array([0, *own[:-1]] if own else [], np.int32))
                ends.append(np.array(own, np.int32))
                whole.append(0 < len(raw) < MIN_RUN)
            starts, ends = np.concatenate(ends[0::2]), np.concatenate(ends[1::2])
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64)
            owner = np.repeat(np.arange(len(counts)), counts)
            yield pa.record_batch([ids.take(pa.array(owner)), pa.array(starts), pa.array(ends - starts), pa.array(np.array(whole)[owner]), pa.array(halves[0::2]), pa.array(halves[1::2])], names=[id_col, *names])

    kinds = {"start": T.IntegerType(), "size": T.IntegerType(), "whole": T.BooleanType(), "high": T.LongType(), "low": T.LongType()}
    names = list(kinds)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in kinds.items())])
    return materialize(docs.select(id_col, text_col).mapInArrow(run, schema), "chunks")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_copies: bool = False) -> DataFrame:
    """(id, start, size, run_bytes, first_id, first): the chunks in runs of MIN_RUN bytes, and with short_copies shorter texts that are copies; first_id: the id of the chunk's first
    occurrence; first: whether this is it."""
    key = ["high", "low"]
    chunks = chunk_table(docs, id_col, text_col)
    again = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(id_col, "start")).alias("least")).where("n > 1")
    found = attach(chunks, materialize(again, "chunks-again"), key)
    found = found.groupBy(id_col, "start", *key).agg(F.max("size").alias("size"), F.first("least").alias("least"), F.first("whole").alias("whole"))
    order = Window.partitionBy(id_col).orderBy("start", *key)
    fresh = F.coalesce(F.lag(F.col("start") + F.col("size")).over(order), F.lit(-1)) != F.col("start")
    found = found.withColumn("run", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    enough = F.col("run_bytes") >= MIN_RUN
    found = found.withColumn("run_bytes", F.sum("size").over(Window.partitionBy(id_col, "run"))).where(enough | F.col("whole") if short_copies else enough)
    is_first = F.col(f"least.{id_col}").eqNullSafe(F.col(id_col)) & (F.col("least.start") == F.col("start"))
    return found.select(id_col, "start", "size", "run_bytes", F.col(f"least.{id_col}").alias("first_id"), is_first.alias("first"))


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_copies: bool = False) -> DataFrame:
    """Per row of docs: id, n_bytes, repeat_bytes (in runs), dup_bytes (of these, not first occurrences), first_ids (sorted: the
    documents in which the chunks that go were found first), spans (of what goes: start:end in bytes, comma-joined)."""
    runs = repeated_runs(docs, id_col, text_col, short_copies)
    dup = ~F.col("first")
    gone = F.array_sort(F.collect_list(F.when(dup, F.struct("start", (F.col("start") + F.col("size")).alias("end")))))
    per = runs.groupBy(F.col(id_col).alias("run_id")).agg(
        F.sum("size").alias("repeat_bytes"),
        F.sum(F.when(dup, F.col("size")).otherwise(0)).alias("dup_bytes"),
        F.array_sort(F.collect_set(F.when(dup, F.col("first_id")))).alias("first_ids"),
        F.get(F.transform(F.array(gone), merged), F.lit(0)).alias("gone"),
    )
    spans = F.array_join(F.transform("gone", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    rows = docs.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    zero = F.lit(0).cast("long")
    return rows.join(per, F.col(id_col).eqNullSafe(F.col("run_id")), "left").select(
        id_col, "n_bytes", F.coalesce("repeat_bytes", zero).alias("repeat_bytes"), F.coalesce("dup_bytes", zero).alias("dup_bytes"),
        F.coalesce("first_ids", F.array().cast(T.ArrayType(docs.schema[id_col].dataType))).alias("first_ids"), F.coalesce(spans, F.lit("")).alias("spans"),
    )


def merged(spans):
    """Sorted spans, a variable of a lambda (a column would be sorted again for each span), with those that touch united."""
    opens = F.transform(spans, lambda s, i: F.when((i == 0) | (F.get(spans, i - 1)["end"] != s["start"]), s["start"]))
    closes = F.transform(spans, lambda s, i: F.when(F.get(spans, i + 1).isNull() | (F.get(spans, i + 1)["start"] != s["end"]), s["end"]))
    return F.arrays_zip(F.array_compact(opens).alias("start"), F.array_compact(closes).alias("end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_copies: bool = False) -> DataFrame:
    """docs with the repeated chunks cut out of text_col, all other columns unchanged."""
    at, cut, docs_columns = docs.columns.index(text_col), unused("cut_spans", docs), docs.columns
    gone = repeated_runs(docs, id_col, text_col, short_copies).where(~F.col("first"))
    gone = gone.groupBy(F.col(id_col).alias("gone_id")).agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias(cut))
    rows = docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]), "left").select(*[docs[c] for c in docs.columns], cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in row_slices(batches, at):
            out = []
            for text, spans in zip(texts, part.column(len(docs_columns)).to_pylist(), strict=True):
                raw, kept, start = text.encode(), [], 0
                for s in spans or ():
                    kept.append(raw[start : s["start"]])
                    start = s["end"]
                out.append(b"".join([*kept, raw[start:]]).decode())
            masked = [None if null else x for x, null in zip(out, part.column(at).is_null().to_pylist(), strict=True)]
            columns = [pa.array(masked, pa.string()) if i == at else part.column(i) for i in range(len(docs_columns))]
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    return rows.mapInArrow(run, docs.schema)
