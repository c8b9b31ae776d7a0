"""WARC archives with an index first: write records, note where each lies, read selected ones by byte range.

Writing takes three steps, none of which shuffles a page. Tasks write every page as one gzip member into drafts of
ARCHIVE_BYTES or so, and return an index row for each: file, offset, length, URL, digest. The index alone then decides
which record holds a payload (the smallest id of equal payloads) and which ones revisit it; digests are counted with
map-side aggregation, and those found more than once are joined back to the index rows. Last, tasks copy the records of
payloads from the drafts as they are, by coalesced byte ranges, put short revisit records in place of the others, and
write the index of the archives so made. The index is written before anything is read.

A reader selects index rows with DataFrame filters; the ranges of a file are sorted, coalesced where less than
MAX_GAP bytes lie between them, up to MAX_READ bytes, and each coalesced range is one read in one task. Ranges are dealt to
tasks by the bytes behind them, not by the size of their index rows.

Archives are written under a name of the attempt and renamed, so a lost executor or a second attempt leaves a
whole file or none. Files are reached through the file system of their URI (file, hdfs, s3 and so on).

Defined cases: a null payload is empty; empty payloads are equal payloads like others; records with the least id
of their payload are all responses, should the id be repeated; a null id comes after all others; a null URL is
written as `urn:absent`; white space and control characters in a URL are percent-encoded in the header, while
the index keeps the URL as it was; a very long page is one record, held by one task; an empty table gives an empty index and
result; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import runtime
from .common import attach, unused

ARCHIVE_BYTES = 256 << 20
MAX_GAP, MAX_READ = 64 << 10, 8 << 20
#: Archive bytes of a task that reads or copies ranges, about.
TASK_BYTES = 64 << 20
LEVEL = 4  # of gzip
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
UNSAFE = re.compile(r"[\x00-\x20\x7f<>]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def member(kind: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head alone and names the record that holds its payload."""
    block = HTTP % size + (payload if kind == "response" else b"")
    target = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url is not None else "urn:absent"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_uri(page_id)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_uri(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and block of one gzip member; the block digest is verified."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if not version.startswith("WARC/") or fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    return fields, block


def page_of(uri: str) -> int | None:
    text = uri.strip("<>").rpartition(":")[2]
    return int(text) if text else None


INDEX = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])


#: What a draft's index has besides.
DRAFT = T.StructType([*INDEX.fields, T.StructField("size", T.LongType())])


def arrow_schema(kind: T.StructType) -> pa.Schema:
    types = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    return pa.schema([(f.name, types[f.dataType]) for f in kind.fields])


class Archives:
    """Writes the records of one task into archives below a folder, and keeps their index rows until they are taken."""

    def __init__(self, folder: str, schema: T.StructType):
        context = TaskContext.get()
        self.store, self.root = pafs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)
        self.prefix = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        self.schema, self.number, self.rows = arrow_schema(schema), 0, []
        self.out, self.name, self.at = None, "", 0

    def add(self, data: bytes, page_id: int | None, kind: str, url: str | None, digest: str, *more) -> None:
        if self.out is None:
            self.name, self.at, self.number = f"{self.prefix}-{self.number:04d}.warc.gz", 0, self.number + 1
            self.out = self.store.open_output_stream(f"{self.root}/{self.name}.open", compression=None)
        self.out.write(data)
        self.rows.append((page_id, kind, url, digest, self.name, self.at, len(data), *more))
        self.at += len(data)

    def finished(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """The index of the open archive, which is closed if it is full or the last one."""
        if self.out is None or not last and self.at < ARCHIVE_BYTES:
            return
        self.out.close()
        self.out = None
        self.store.move(f"{self.root}/{self.name}.open", f"{self.root}/{self.name}")
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
        self.rows = []


def write_drafts(pages: DataFrame, path: str) -> DataFrame:
    """Every page as a response below path/drafts; returns their index, a written table of DRAFT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Archives(f"{path}/drafts", DRAFT)
        for batch in batches:
            for start in range(0, len(batch), 200):
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.slice(start, 200).columns), strict=True):
                    payload = (html or "").encode()
                    digest = base32_sha1(payload)
                    out.add(member("response", page_id, url, digest, len(payload), payload, None), page_id, "response", url, digest, len(payload))
                    yield from out.finished()
        yield from out.finished(last=True)

    index = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, DRAFT)
    return runtime.materialize(index, "warc-drafts")


def first_of_payload(index: DataFrame) -> DataFrame:
    """index, a written table with page_id and digest, and first_id: of revisits the record that holds their payload, else null."""
    first = unused("first_id", index)
    again = index.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias(first)).where("n > 1")
    joined = attach(index, runtime.materialize(again, "warc-again"), "digest", "left")
    return joined.withColumn(first, F.when(~F.col(first).eqNullSafe(F.col("page_id")), F.col(first)))


def ranges(selected: DataFrame, *columns: str) -> DataFrame:
    """(file, stretch, places) of index rows: a row for each stretch of MAX_READ bytes of a file, dealt evenly to a task for
    TASK_BYTES of archives, or one for each core; places: the stretch's rows, with offset, length and the columns named."""
    held = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, -(-held // TASK_BYTES))
    grouped = selected.groupBy("file", F.floor(F.col("offset") / MAX_READ).alias("stretch"))
    return grouped.agg(F.collect_list(F.struct("offset", "length", *columns)).alias("places")).repartition(tasks)


def write(pages: DataFrame, path: str) -> DataFrame:
    """Write archives below path/archives and the index to path/index; returns the index as read from there."""
    decided = first_of_payload(write_drafts(pages, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(f"{path}/drafts")
        out = Archives(f"{path}/archives", INDEX)
        for batch in batches:
            for file, places in zip(batch.column(0), batch.column(2), strict=True):
                with store.open_input_file(f"{root}/{file}") as source:
                    for group in coalesced(places.as_py()):
                        base = group[0]["offset"]
                        data = source.read_at(end_of(group[-1]) - base, base)
                        for p in group:
                            fields = p["page_id"], p["url"], p["digest"]
                            if p["first_id"] is None:
                                kind, raw = "response", data[p["offset"] - base : end_of(p) - base]
                            else:
                                kind, raw = "revisit", member("revisit", *fields, p["size"], b"", p["first_id"])
                            out.add(raw, p["page_id"], kind, p["url"], p["digest"])
                        yield from out.finished()
        yield from out.finished(last=True)

    copies = ranges(decided, "page_id", "url", "digest", "size", "first_id")
    copies.mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return read_index(pages.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def end_of(place: dict) -> int:
    return place["offset"] + place["length"]


def coalesced(places: list[dict]) -> Iterator[list[dict]]:
    """Places (offset, length), sorted and in groups that one read covers."""
    group: list[dict] = []
    for p in sorted(places, key=lambda p: (p["offset"], p["length"])):
        if group and (p["offset"] - end_of(group[-1]) > MAX_GAP or end_of(p) - group[0]["offset"] > MAX_READ):
            yield group
            group = []
        group.append(p)
    if group:
        yield group


def read(selected: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """RECORD of each selected index row, read from the archives; payload is null for revisits, or if not wanted.

    A task gets whole stretches of MAX_READ bytes of a file, so that neighbours can be read at once.
    """
    arrow = arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(f"{path}/archives")
        for batch in batches:
            for file, places in zip(batch.column(0), batch.column(2), strict=True):
                with store.open_input_file(f"{root}/{file}") as source:
                    for group in coalesced(places.as_py()):
                        base = group[0]["offset"]
                        data = source.read_at(end_of(group[-1]) - base, base)
                        rows = [record(data[p["offset"] - base : end_of(p) - base], payloads) for p in group]
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return ranges(selected).mapInArrow(run, RECORD)


def record(data: bytes, payloads: bool) -> dict:
    """RECORD of one gzip member; a response's payload digest is verified."""
    fields, block = parse(data)
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    refers = page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    return {
        "page_id": page_of(fields["warc-record-id"]), "record_type": kind, "target_uri": fields["warc-target-uri"], "payload_digest": digest,
        "payload_bytes": size, "refers_to": refers, "payload": payload if payloads and kind == "response" else None,
    }


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to the shared folder and return what reading all records gives, without payloads."""
    path = runtime.work_path(pages.sparkSession, "warc")
    index = write(pages, path)
    return read(index, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
