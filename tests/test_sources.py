"""Readers of repository files, and streams against tables."""

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from oakgraph.functions import names as N
from oakgraph.functions import objects as O
from oakgraph.operators import store, trees
from oakgraph.sources import files
from oakgraph.streaming import packets


def staging_file(entries, version=2):
    out = b"DIRC" + struct.pack(">II", version, len(entries))
    for path, mode, flags, oid in entries:
        one = struct.pack(">10I20sH", 1, 2, 3, 4, 5, 6, mode, 7, 8, 9, bytes.fromhex(oid), flags | min(len(path), 0xFFF))
        if version == 3 and flags & N.EXTENDED:
            one += struct.pack(">H", N.INTENT_TO_ADD)
        one += path.encode()
        out += one + b"\x00" * (8 - len(one) % 8)
    return out + hashlib.sha1(out).digest()


@pytest.mark.parametrize("version", [2, 3])
def test_staging_file(spark, tmp_path, version):
    oid = O.EMPTY_BLOB
    flags = N.EXTENDED if version == 3 else 0x1000
    entries = [("a", 0o100644, 0, oid), ("dir/file2", 0o120000, flags, oid), ("x" * 40, 0o100755, 0x2000, oid)]
    (tmp_path / "index").write_bytes(staging_file(entries, version))
    got = files.staging_files(spark, str(tmp_path)).withColumn("stage", N.stage(F.col("flags"))).orderBy("path").collect()
    assert [(r["path"], r["mode"], r["oid"], r["size"], r["mtime"]) for r in got] == [(p, m, o, 9, 3) for p, m, _, o in entries]
    assert [r["stage"] for r in got] == [0, 0 if version == 3 else 1, 2]


def test_staging_files_round_trip(spark, tmp_path):
    oid, long = O.EMPTY_BLOB, "y" * 5000
    rows = [
        ("a/index", "b", 0o100644, N.ASSUME_VALID, 0, oid, 5, 7),
        ("a/index", "é", 0o100755, 0x2000, 0, oid, None, None),
        ("a/index", "b", 0o100644, 0x1000, 0, oid, 2**32 + 1, 1),
        ("other", long, 0o120000, 0, N.SKIP_WORKTREE, oid, 1, 1),
        ("other", "B", 0o160000, 0, None, oid, 1, 1),
    ]
    written = files.write_staging(spark.createDataFrame(rows, files.STAGED).repartition(3), str(tmp_path)).orderBy("file").collect()
    assert [(r["file"], r["version"], r["number"]) for r in written] == [("a/index", 2, 3), ("other", 3, 2)]
    for r in written:
        data = (tmp_path / r["file"]).read_bytes()
        assert data[-20:].hex() == r["checksum"] == hashlib.sha1(data[:-20]).hexdigest()
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file() and p.suffix != ".crc") == ["index", "other"]
    got = lambda f: [tuple(r)[1:] for r in files.staging_files(spark, str(tmp_path / f)).collect()]
    assert got("a") == [("b", 0o100644, N.ASSUME_VALID | 1, 0, oid, 5, 7), ("b", 0o100644, 0x1001, 0, oid, 1, 1), ("é", 0o100755, 0x2002, 0, oid, 0, 0)]
    assert got("other") == [("B", 0o160000, 1, 0, oid, 1, 1), (long, 0o120000, N.EXTENDED | 0xFFF, N.SKIP_WORKTREE, oid, 1, 1)]


def test_staging_files_of_many_entries_are_whole(spark, tmp_path):
    """Entries enough for several tasks, and few files: a join with them would be turned into a broadcast, and files dealt to several tasks."""
    spark.range(0, 40_000, 1, 8).write.parquet(f"{tmp_path}/in")
    name = F.concat(F.lit("part-"), (F.col("id") % 7).cast("string"))
    path = F.concat(F.lit("d/"), F.sha1(F.col("id").cast("string")))
    rows = spark.read.parquet(f"{tmp_path}/in").select(name.alias("file"), path.alias("path"), F.lit(0o100644).alias("mode"), F.lit(0).alias("flags"), F.lit(0).alias("extended"), F.sha1(F.col("id").cast("string")).alias("oid"), F.col("id").alias("size"), F.lit(0).cast("long").alias("mtime"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "20k", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        written = files.write_staging(rows, f"{tmp_path}/out").collect()
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert sorted(r["file"] for r in written) == [f"part-{i}" for i in range(7)] and sum(r["number"] for r in written) == 40_000
    got = files.staging_files(spark, f"{tmp_path}/out")
    assert got.select("path", "oid", "size").exceptAll(rows.select("path", "oid", "size")).isEmpty() and got.count() == 40_000


def test_staging_file_as_built_by_hand(spark, tmp_path):
    rows = [("index", "a", 0o100644, 0, 0, O.EMPTY_BLOB, 9, 3), ("index", "dir/file2", 0o100755, 0x1000, N.INTENT_TO_ADD, O.EMPTY_BLOB, 9, 3)]
    files.write_staging(spark.createDataFrame(rows, files.STAGED), str(tmp_path))
    data = b"DIRC" + struct.pack(">II", 3, 2)
    for _, path, mode, flags, extended, oid, size, mtime in rows:
        one = bytes(8) + struct.pack(">I", mtime) + bytes(12) + struct.pack(">I", mode) + bytes(8) + struct.pack(">I", size) + bytes.fromhex(oid)
        one += struct.pack(">H", flags | (N.EXTENDED if extended else 0) | len(path)) + (struct.pack(">H", extended) if extended else b"") + path.encode()
        data += one + bytes(8 - len(one) % 8)
    assert (tmp_path / "index").read_bytes() == data + hashlib.sha1(data).digest()


def test_staging_files_of_no_and_of_broken_entries(spark, tmp_path):
    none = spark.createDataFrame([], files.STAGED)
    assert files.write_staging(none, str(tmp_path)).count() == 0
    for path, message in ((None, "without path"), ("a\0b", "NUL in the path")):
        rows = spark.createDataFrame([("index", path, 0o100644, 0, 0, O.EMPTY_BLOB, 1, 1)], files.STAGED)
        with pytest.raises(Exception, match=message):
            files.write_staging(rows, str(tmp_path))


def test_who_may_leave_out_done(spark):
    rows = spark.createDataFrame([(["no-done", "multi_ack"],), (["multi_ack"],)], "shared array<string>")
    got = rows.select(N.no_done(F.col("shared")), N.no_done(F.col("shared"), stateless=True)).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True)]


def test_endpoints_are_printed(spark):
    urls = ["ssh://git@host:22/a/b", "git@host:a/b.git", "HTTP://host", "https://u:secret@h/x", "no address"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(N.print_endpoint(N.parse_endpoint(F.col("u"))).alias("p")).collect()
    assert [r["p"] for r in got] == ["ssh://git@host:22/a/b", "ssh://git@host/a/b.git", "http://host/", "https://u@h/x", None]


def test_damaged_staging_file(spark, tmp_path):
    (tmp_path / "index").write_bytes(staging_file([("a", 0o100644, 0, O.EMPTY_BLOB)])[:-1] + b"!")
    with pytest.raises(Exception, match="no whole staging file"):
        files.staging_files(spark, str(tmp_path)).collect()


def test_loose_objects_of_wrong_name_or_content(spark, tmp_path):
    root = f"file://{tmp_path}/objects"
    payloads = spark.createDataFrame([("blob", bytearray(b"hoho")), ("blob", bytearray(b"")), ("tree", bytearray(b"")), ("blob", bytearray(b"hoho"))], "kind string, payload binary")
    assert files.write_loose(payloads, root) == 3
    bad = tmp_path / "objects" / "00"
    bad.mkdir()
    (bad / ("0" * 38)).write_bytes(zlib.compress(b"blob 1\x00x"))
    (bad / ("1" * 38)).write_bytes(b"no zlib")
    (bad / "other").write_bytes(b"x")
    got = {r["oid"]: (r["kind"], r["size"], r["payload"]) for r in files.loose_objects(spark, root).collect()}
    assert got == {
        "db746e52ad9a10a5607b9c2bddec2355859c6046": ("blob", 4, b"hoho"), O.EMPTY_BLOB: ("blob", 0, b""), O.EMPTY_TREE: ("tree", 0, b""),
        "0" * 40: (None, None, None), "00" + "1" * 38: (None, None, None),
    }


def test_loose_objects_in_folders_of_all_kinds(spark, tmp_path):
    """Objects are found at any depth and by any reader, and no file is a row of a listing that the driver gathers."""
    payloads = spark.range(300).select(F.lit("blob").alias("kind"), F.encode((F.col("id") % 200).cast("string"), "UTF-8").alias("payload")).repartition(7)
    for below in ("a/objects", "a/.hidden", "a/ab"):
        assert files.write_loose(payloads, f"file://{tmp_path}/{below}") == 200
    assert files.write_loose(payloads.limit(250), f"file://{tmp_path}/a/objects") <= 200  # what is there stays
    assert not list(tmp_path.rglob("tmp-*")) and len([p for p in (tmp_path / "a/objects").rglob("*") if p.is_file() and len(p.name) == 38]) == 200
    want = sorted(hashlib.sha1(b"blob %d\0" % len(str(i)) + str(i).encode()).hexdigest() for i in range(200))
    read = lambda root: sorted(r["oid"] for r in files.loose_objects(spark, root).where("kind = 'blob'").collect())
    assert read(f"file://{tmp_path}/a/objects") == read(f"{tmp_path}/a/objects") == read(f"{tmp_path}/a/obj*") == want
    assert read(f"file://{tmp_path}/a") == sorted(want * 2)
    first = want[0][:2]
    assert read(f"file://{tmp_path}/a/objects/{first}") == [w for w in want if w[:2] == first]
    plan = files.loose_objects(spark, f"file://{tmp_path}/a/objects")._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "Aggregate" not in plan
    (tmp_path / "none").mkdir()
    assert read(f"{tmp_path}/none") == []


def test_reference_files(spark, tmp_path):
    (tmp_path / "refs/heads").mkdir(parents=True)
    (tmp_path / "HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / "refs/heads/main").write_text(O.EMPTY_BLOB + "\n")
    (tmp_path / "config").write_text("x\n")
    assert sorted(map(tuple, files.reference_files(spark, str(tmp_path)).collect())) == [("HEAD", None, "refs/heads/main"), ("refs/heads/main", O.EMPTY_BLOB, None)]


def test_packet_captures(spark, tmp_path):
    (tmp_path / "c").write_bytes(b"0009\x01data0000" + b"0008\x02abc")
    got = files.packet_captures(spark, str(tmp_path)).orderBy("seq")
    assert [bytes(r["packet"]) for r in got.collect()] == [b"0009\x01data", b"0000", b"0008\x02abc"]
    assert [(r["channel"], bytes(r["payload"])) for r in packets.demultiplex(got).orderBy("seq").collect()] == [(1, b"data"), (2, b"abc")]


def test_stream_demultiplexes_like_a_table(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 3).alias("stream"), packets.frame(F.concat(F.when(F.col("id") % 2 == 0, F.lit(b"\x01")).otherwise(F.lit(b"\x03")), F.encode(F.col("id").cast("string"), "UTF-8"))).alias("packet"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = packets.demultiplex(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, packets.demultiplex(rows).collect()))


def test_staged_paths_roll_up_to_the_same_tree_whatever_their_order(spark):
    rows = [(f"d{i % 3}/e{i % 2}/f{i}" if i % 5 else f"f{i}", "100644", f"{i:040x}") for i in range(60)]
    ids = set()
    for seed in (1, 2):
        written = trees.write_trees(spark.createDataFrame(rows, "path string, perm string, node string").repartition(seed + 1))
        ids.add(written.where("path = ''").first()["oid"])
        assert written.where("perm = '40000'").count() == 1 + 3 + 6
    assert len(ids) == 1


def test_first_tier_wins(spark):
    layer = lambda *x: spark.createDataFrame(list(x), "oid string, kind string")
    assert {r["oid"]: r["kind"] for r in store.tiers(layer(("a", "pack")), layer(("a", "loose"), ("b", "loose"))).collect()} == {"a": "pack", "b": "loose"}
