"""Files of a repository as tables: loose objects, references, packed references, staging files, packet captures.

Files are found and read by Spark's own readers, so any file system it knows will do. Python decodes binary layouts
alone, in Arrow batches, one small function for each layout.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import objects as O
from ..runtime import materialize


def _binary(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


#: An object's file, with the folder that it is in.
LOOSE = re.compile(r"/([0-9a-f]{2}/[0-9a-f]{38})$")
#: Bytes of file contents that are handed on at once.
LOOSE_BATCH = 4 << 20


def _loose_folders(store: pafs.FileSystem, base: str) -> list[str]:
    """The folders at or below base that may hold objects, by their names of two digits; what is below such a folder is not listed."""
    todo, found = [base.rstrip("/")], []
    while todo:
        at = todo.pop()
        if re.search(r"/[0-9a-f]{2}$", at):
            found.append(at)
        else:
            todo += [f.path for f in store.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.Directory and f.base_name[0] not in "._"]
    return sorted(found)


def _loose_contents(spark: SparkSession, root: str) -> DataFrame:
    """(oid, content) of the files below root that have an object's name. Where tasks can open root themselves, each lists and reads some of its folders, so
    that no list of all files is gathered and a task takes many small files; else by Spark's reader."""
    try:
        store, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
        folders = None if re.search(r"[*?{\[]", root) else _loose_folders(store, base)
    except (OSError, ValueError):  # pa.ArrowInvalid is a ValueError
        folders = None
    if folders is None:
        name = F.regexp_extract("path", LOOSE.pattern, 1)
        return _binary(spark, root).where(name != "").select(F.replace(name, F.lit("/")).alias("oid"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["oid", "content"])
        store = None
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store = store or pafs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")[0]
                rows, held = [], 0
                for f in store.get_file_info(pafs.FileSelector(folder, recursive=True)):
                    name = LOOSE.search(f.path)
                    if f.type != pafs.FileType.File or not name or re.search(r"/[._]", f.path[len(folder) :]):
                        continue
                    with store.open_input_stream(f.path) as file:
                        rows.append((name[1].replace("/", ""), file.read()))
                    held += len(rows[-1][1])
                    if held >= LOOSE_BATCH:
                        yield pack(rows)
                        rows, held = [], 0
                yield pack(rows)

    parts = max(1, min(len(folders), 256))
    return spark.createDataFrame([(f,) for f in folders], "folder string").repartition(parts).mapInArrow(read, "oid string, content binary")


def loose_objects(spark: SparkSession, root: str) -> DataFrame:
    """(oid, kind, size, payload) of the compressed objects below root, named by two digits, a slash and the rest.

    Other files are passed over. A file that cannot be inflated, has a wrong length or another digest than its name gives nulls.
    """

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    out.append(zlib.decompress(data))
                except zlib.error:
                    out.append(None)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["oid", "whole"])

    whole = _loose_contents(spark, root).mapInArrow(inflate, "oid string, whole binary")
    return whole.select("oid", F.when(F.sha1("whole") == F.col("oid"), O.split_raw(F.col("whole"))).alias("o")).select("oid", "o.kind", "o.size", "o.payload")


def write_loose(objects: DataFrame, root: str, level: int = 6) -> int:
    """Write objects (kind, payload), each once, as compressed files below root; returns how many. Files get their names by renaming.

    An object that is there is passed over, so that payloads need no shuffle: copies that tasks meet at once are renamed to one file.
    """
    rows = objects.select(O.object_id(F.col("kind"), F.col("payload")).alias("oid"), O.raw(F.col("kind"), F.col("payload")).alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(root)
        made, draft = set(), uuid.uuid4().hex
        for batch in batches:
            for oid, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{base}/{oid[:2]}"
                target = f"{folder}/{oid[2:]}"
                if oid[:2] not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(oid[:2])
                if store.get_file_info(target).type == pafs.FileType.NotFound:
                    with store.open_output_stream(f"{folder}/tmp-{draft}") as out:
                        out.write(zlib.compress(whole, level))
                    store.move(f"{folder}/tmp-{draft}", target)
            yield pa.record_batch([batch.column(0)], names=["oid"])

    return rows.mapInArrow(run, "oid string").agg(F.count_distinct("oid")).first()[0]


def reference_files(spark: SparkSession, root: str) -> DataFrame:
    """(name, oid, ref) of HEAD and the files below refs."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root).select("value", F.input_file_name().alias("path"))
    name = F.regexp_extract("path", r"/(HEAD|refs/.+)$", 1)
    return files.where(name != "").select(name.alias("name"), N.parse_contents(F.col("value")).alias("c")).select("name", "c.oid", "c.ref")


def packed_references(spark: SparkSession, path: str) -> DataFrame:
    """(name, oid, peeled_oid) of a text of `<id> <name>` lines, where `^<id>` is what the line before it peels to."""
    text = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    lines = text.where("line <> '' and line not like '#%'")
    after = F.lead("line").over(Window.partitionBy("file").orderBy("n"))
    own = lines.withColumn("after", after).where(~F.startswith("line", F.lit("^")))
    peeled = F.when(F.startswith("after", F.lit("^")), F.substring("after", 2, 100))
    return own.select(F.regexp_extract("line", r"^\S+ (.*)$", 1).alias("name"), F.substring_index("line", " ", 1).alias("oid"), peeled.alias("peeled_oid"))


#: Entries of a tree that are held as Python objects at once.
ENTRY_ROWS = 10_000
ENTRY = "tree string, pos int, perm string, name string, node string"


def tree_entries(trees: DataFrame, digest_size: int = 20) -> DataFrame:
    """trees (tree, payload): the entries of tree objects, in their order; a payload that ends within an entry raises an error."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int32()), ("perm", pa.string()), ("name", pa.string()), ("node", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, at, pos = [], 0, 0
                while at < len(payload):
                    space = payload.index(b" ", at)
                    end = payload.index(b"\x00", space)
                    node = payload[end + 1 : end + 1 + digest_size]
                    if len(node) < digest_size:
                        raise ValueError(f"tree {tree} ends within an entry")
                    rows.append({"tree": tree, "pos": pos, "perm": payload[at:space].decode(), "name": payload[space + 1 : end].decode(errors="replace"), "node": node.hex()})
                    at, pos = end + 1 + digest_size, pos + 1
                    if len(rows) == ENTRY_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return trees.select("tree", "payload").mapInArrow(run, ENTRY).withColumn("perm", O.permission(F.col("perm")))


STAGED = "file string, path string, mode int, flags int, extended int, oid string, size long, mtime long"
STAGED_SCHEMA = pa.schema([("file", pa.string()), ("path", pa.string()), ("mode", pa.int32()), ("flags", pa.int32()), ("extended", pa.int32()), ("oid", pa.string()), ("size", pa.int64()), ("mtime", pa.int64())])


def staging_files(spark: SparkSession, path: str) -> DataFrame:
    """STAGED entries of staging files of version 2 or 3: `DIRC`, version, number, entries padded to eight bytes, checksum.

    extended: the second flag word that version 3 may have, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                magic, version, number = struct.unpack_from(">4sII", data)
                if magic != b"DIRC" or version not in (2, 3) or hashlib.sha1(data[:-20]).digest() != data[-20:]:
                    raise ValueError(f"{file} is no whole staging file of version 2 or 3")
                rows, at = [], 12
                for _ in range(number):
                    f = struct.unpack_from(">10I20sH", data, at)
                    more = version == 3 and f[11] & N.EXTENDED
                    start = at + 62 + (2 if more else 0)
                    end = data.index(b"\x00", start)
                    extended = struct.unpack_from(">H", data, at + 62)[0] if more else 0
                    rows.append({"file": file, "path": data[start:end].decode(), "mode": f[6], "flags": f[11], "extended": extended, "oid": f[10].hex(), "size": f[9], "mtime": f[2]})
                    at += (end - at) // 8 * 8 + 8
                    if len(rows) == ENTRY_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, STAGED_SCHEMA)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, STAGED_SCHEMA)

    return _binary(spark, path).select("path", "content").mapInArrow(run, STAGED)


def staged_bytes(path: str, mode: int, flags: int, extended: int, oid: str, size: int, mtime: int) -> bytes:
    """An entry as a staging file has it; fields that STAGED lacks are 0."""
    name = path.encode()
    if b"\x00" in name:
        raise ValueError(f"NUL in the path {path!r}")
    flags = flags & (N.ASSUME_VALID | N.STAGES) | (N.EXTENDED if extended else 0) | min(len(name), N.NAME_LENGTH)
    entry = struct.pack(">10I20sH", 0, 0, mtime & 0xFFFFFFFF, 0, 0, 0, mode, 0, 0, size & 0xFFFFFFFF, bytes.fromhex(oid), flags)
    entry += (struct.pack(">H", extended) if extended else b"") + name
    return entry + bytes(8 - len(entry) % 8)


class _StagingFile:
    """A staging file as it is written: what passes by is digested, the digest ends the file, and it gets its name at the end."""

    def __init__(self, store: pafs.FileSystem, base: str, file: str, version: int, number: int):
        self.store, self.target, self.file, self.version, self.number = store, f"{base}/{file}", file, version, number
        folder = self.target.rpartition("/")[0]
        store.create_dir(folder, recursive=True)
        self.draft = f"{folder}/_tmp-{uuid.uuid4().hex}"
        self.out, self.digest = store.open_output_stream(self.draft), hashlib.sha1()
        self.add(struct.pack(">4sII", b"DIRC", version, number))

    def add(self, data: bytes) -> None:
        self.digest.update(data)
        self.out.write(data)

    def close(self) -> dict:
        self.out.write(self.digest.digest())
        self.out.close()
        self.store.move(self.draft, self.target)
        return {"file": self.file, "version": self.version, "number": self.number, "checksum": self.digest.hexdigest()}


def write_staging(entries: DataFrame, root: str) -> DataFrame:
    """Write entries (STAGED) as staging files below root, one for each file; returns (file, version, number, checksum) of what was written.

    Entries are in the order of their paths' bytes, then stages; version 3 if one has extended flags, else 2. The length in the flags is that of
    the path. A file is one digest, so one task writes it, entry by entry in little memory. Nulls in extended, flags, size and mtime are 0;
    without file, path, mode or oid an error is raised. Files get their names by renaming, so a task that runs again writes the same.
    """
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("flags", "extended", "size", "mtime")]
    needed = [F.coalesce(c, F.raise_error(F.lit(f"an entry without {c}")).cast(kind)).alias(c) for c, kind in (("file", "string"), ("path", "string"), ("mode", "int"), ("oid", "string"))]
    rows = entries.select(*needed, *zero)
    order = F.encode("path", "UTF-8"), N.stage(F.col("flags"))
    whole = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = ("path", "mode", "flags", "extended", "oid", "size", "mtime")
    # The window keeps a file in one task. A repartition by file would be dropped after a join by file, and the join's own exchange may be read in pieces.
    rows = rows.withColumns({"number": F.count(F.lit(1)).over(whole), "version": F.when(F.max("extended").over(whole) > 0, 3).otherwise(2)})
    placed = rows.sortWithinPartitions("file", *order)
    schema = pa.schema([("file", pa.string()), ("version", pa.int32()), ("number", pa.int64()), ("checksum", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(root)
        out = None
        for batch in batches:
            done = []
            for file, version, number, *entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or out.file != file:
                    if out is not None:
                        done.append(out.close())
                    out = _StagingFile(store, base, file, version, number)
                out.add(staged_bytes(*entry))
            yield pa.RecordBatch.from_pylist(done, schema)
        if out is not None:
            yield pa.RecordBatch.from_pylist([out.close()], schema)

    written = placed.select("file", "version", "number", *columns).mapInArrow(run, "file string, version int, number long, checksum string")
    return materialize(written, "staging")


def packet_captures(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, packet): the packets of captured byte streams, flushes as `0000`; a capture that ends within a packet raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packets, at = [], 0
                while at < len(data):
                    size = max(4, int(data[at : at + 4], 16))
                    if at + size > len(data):
                        raise ValueError(f"{file} ends within a packet")
                    packets.append(data[at : at + size])
                    at += size
                yield pa.record_batch([pa.array([file] * len(packets)), pa.array(range(len(packets)), pa.int64()), pa.array(packets, pa.binary())], names=["file", "seq", "packet"])

    return _binary(spark, path).select("path", "content").mapInArrow(run, "file string, seq long, packet binary")
