"""Identities, codecs and names against known values and plain Python."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oakgraph import runtime
from oakgraph.functions import names as N
from oakgraph.functions import objects as O
from oakgraph.operators import graph, refs, store, trees


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_known_ids(spark):
    assert one(spark, O.blob_id(F.lit(""))) == O.EMPTY_BLOB
    assert one(spark, O.blob_id(F.lit("hoho"))) == "db746e52ad9a10a5607b9c2bddec2355859c6046"
    assert one(spark, O.object_id("tree", F.lit(b""))) == O.EMPTY_TREE
    assert one(spark, F.sha1(F.lit(b""))) == O.NULL_ID


def test_blob_id_of_bytes_not_characters(spark):
    text = "é\x00ü" * 7
    data = text.encode()
    assert one(spark, O.blob_id(F.lit(text))) == hashlib.sha1(b"blob %d\x00" % len(data) + data).hexdigest()


def test_tree_order_puts_directories_after_dots(spark):
    rows = spark.createDataFrame([("t", "100755", "foo1", "00"), ("t", "40000", "foo", "00"), ("t", "100644", "foo.c", "00")], "tree string, perm string, name string, node string")
    assert [r["name"] for r in trees.ordered(rows).orderBy("pos").collect()] == ["foo.c", "foo", "foo1"]
    added = trees.add(rows, spark.createDataFrame([("t", "100644", "foo", "01")], rows.schema))
    assert [r["name"] for r in trees.ordered(added).orderBy("pos").collect()] == ["foo", "foo.c", "foo1"]
    assert trees.remove(rows, spark.createDataFrame([("t", "nothing")], "tree string, name string")).count() == 3


def test_permission_aliases(spark):
    assert [one(spark, O.permission(F.lit(p))) for p in ("44", "040000", "120000", "7")] == ["100644", "40000", "120000", None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("abc .", max_size=8).map(lambda s: "n" + s.strip()), st.integers(-(2**40), 2**40), st.sampled_from(["+0000", "-0000", "+0530", "-0330"])), min_size=1, max_size=20))
def test_user_line_round_trip(spark, people):
    df = spark.createDataFrame([(i, n, t, z) for i, (n, t, z) in enumerate(people)], "i int, n string, t long, z string")
    got = df.select("i", O.parse_user(O.user_line(F.col("n"), F.lit("a@b"), F.col("t"), F.col("z"))).alias("u")).orderBy("i").collect()
    for r, (n, t, z) in zip(got, people, strict=True):
        minutes = int(z[1:3]) * 60 + int(z[3:])
        assert (r["u"]["name"], r["u"]["email"], r["u"]["ts"], r["u"]["tz"]) == (n, "a@b", t, (-minutes if z[0] == "-" else minutes) or None)


@pytest.mark.parametrize("message", [None, "", "hello\n\nworld\n"])
def test_commit_and_tag_keep_absent_and_empty_messages_apart(spark, message):
    user = O.user_line(F.lit(""), F.lit("e@x"), F.lit(5), F.lit("+0000"))
    text = F.lit(message).cast("string")
    extra = F.array(F.struct(F.lit("sig").alias("key"), F.array(F.lit("a"), F.lit("b c")).alias("lines")))
    parents = F.array(F.lit("ab"), F.lit("cd"))
    c = one(spark, O.parse_commit(O.commit_payload(F.lit("00"), parents, user, user, extra, text)))
    assert (c["tree"], c["parents"], c["message"], c["author"]["name"]) == ("00", ["ab", "cd"], message, "")
    assert [(e["key"], e["lines"]) for e in c["extra"]] == [("sig", ["a", "b c"])]
    t = one(spark, O.parse_tag(O.tag_payload(F.lit("aa"), F.lit("commit"), F.lit("v1"), F.lit(None).cast("string"), text)))
    assert (t["obj"], t["tag"], t["tagger"], t["message"]) == ("aa", "v1", None, message)


def test_split_raw_refuses_wrong_lengths(spark):
    assert one(spark, O.split_raw(F.lit(b"blob 3\x00abc")))["payload"] == b"abc"
    assert one(spark, O.split_raw(F.lit(b"blob 4\x00abc"))) is None
    assert one(spark, O.split_raw(F.lit(b"blub 3\x00abc"))) is None


def test_names(spark):
    assert one(spark, N.clean_name(F.lit("refs//heads///x"))) == "refs/heads/x"
    assert one(spark, N.clean_name(F.lit("/refs"))) is None
    assert one(spark, N.append(F.lit("a"), F.lit("/b"))) == "/b"
    e = one(spark, N.parse_endpoint(F.lit("me@example.org:dir/repo")))
    assert (e["scheme"], e["user"], e["host"], e["path"]) == ("ssh", "me", "example.org", "dir/repo")
    e = one(spark, N.parse_endpoint(F.lit("https://u:p@example.org:8443/x")))
    assert (e["scheme"], e["user"], e["password"], e["port"], e["path"]) == ("https", "u", "p", 8443, "/x")
    assert one(spark, N.basic_auth(F.lit("u"), F.lit("p"))) == "Basic dTpw"


def test_flush_schedule():
    assert [refs.next_flush(n, False) for n in (16, 32, 64)] == [32, 64, 96]
    assert [refs.next_flush(n, True) for n in (16, 8192, 16384)] == [32, 16384, 18022]


def test_strict_read_raises_for_missing_objects(spark):
    objects = store.objects_of(spark.createDataFrame([("x",)], "t string"), "blob", F.encode("t", "UTF-8"))
    wanted = spark.createDataFrame([("no",)], "oid string")
    assert store.read(objects, wanted).first()["kind"] is None
    with pytest.raises(Exception, match="no object"):
        store.read(objects, wanted, strict=True).collect()


def test_writing_twice_writes_nothing(spark):
    objects = store.objects_of(spark.createDataFrame([("x",), ("x",), ("y",)], "t string"), "blob", F.encode("t", "UTF-8"))
    assert objects.count() == 2
    assert store.append(objects, objects).count() == 0


def test_closure_keeps_low_nodes_that_are_not_reached(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("a", "gone")], "src string, dst string")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    nodes, turned = graph.closure(edges, node("a", "b", "c", "x"), node("c", "x"), node("a"))
    assert sorted(r[0] for r in nodes.collect()) == ["a", "b", "c", "x"]
    assert sorted(map(tuple, turned.collect())) == [("b", "a"), ("c", "b")]
    levels = {r["node"]: r["level"] for r in graph.topological_levels(turned, nodes).collect()}
    assert all(levels[a] < levels[b] for a, b in map(tuple, turned.collect()))


def test_topological_levels_refuse_cycles(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a")], "src string, dst string")
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_levels(edges, spark.createDataFrame([("r",), ("a",), ("b",)], "node string"))


def test_reference_cycle(spark):
    got = refs.resolve(spark.createDataFrame([("a", None, "b"), ("b", None, "a"), ("c", "1", None), ("d", None, "c")], "name string, oid string, ref string"))
    assert {r["name"]: r["state"] for r in got.collect()} == {"a": "cycle", "b": "cycle", "c": "ok", "d": "ok"}


def test_trees_are_hashed_without_a_row_that_holds_them(spark):
    entries = spark.range(25_000).select(F.concat(F.lit("d"), (F.col("id") % 2).cast("string")).alias("tree"), F.lit("100644").alias("perm"), F.concat(F.lit("doc"), F.col("id").cast("string")).alias("name"), F.sha1(F.col("id").cast("string")).alias("node"))
    whole = entries.groupBy("tree").agg(O.tree_payload(F.col("perm"), F.col("name"), F.col("node")).alias("payload"), F.count(F.lit(1)).alias("n")).select("tree", O.object_id("tree", F.col("payload")), "n", F.octet_length("payload"))
    ids = trees.tree_ids(entries)
    assert sorted(map(tuple, ids.collect())) == sorted(map(tuple, whole.collect()))
    assert "collect_list" not in ids._jdf.queryExecution().toString()


def test_long_chains_of_references_are_no_cycles(spark):
    rows = [(f"r{i}", None, f"r{i + 1}") for i in range(100)] + [("r100", "x", None), ("c0", None, "c1"), ("c1", None, "c0"), ("lost", None, "nowhere")]
    got = {r["name"]: (r["oid"], r["hops"], r["state"]) for r in refs.resolve(spark.createDataFrame(rows, "name string, oid string, ref string")).collect()}
    assert got == {f"r{i}": ("x", 100 - i, "ok") for i in range(101)} | {"c0": (None, None, "cycle"), "c1": (None, None, "cycle"), "lost": (None, None, "missing")}


def test_open_references_alone_are_followed_on(spark, monkeypatch):
    steps = []

    def noted(df, label, *rest):
        out = runtime.materialize(df, label, *rest)
        steps.append(out.count())
        return out

    monkeypatch.setattr(refs, "materialize", noted)
    rows = [(f"c{i}", "id" if i == 0 else None, f"c{i - 1}" if i else None) for i in range(10)] + [(f"n{i}", None, f"n{(i + 1) % 5}") for i in range(5)]
    rows += [("lost", None, "none"), ("to lost", None, "lost"), ("to circle", None, "n3"), ("nothing", None, None)] + [(f"plain{i}", f"id{i}", None) for i in range(200)]
    got = {r["name"]: (r["oid"], r["hops"], r["state"]) for r in refs.resolve(spark.createDataFrame(rows, "name string, oid string, ref string")).collect()}
    want = {f"c{i}": ("id", i, "ok") for i in range(10)} | {f"plain{i}": (f"id{i}", 0, "ok") for i in range(200)} | {f"n{i}": (None, None, "cycle") for i in range(5)} | {"to circle": (None, None, "cycle")}
    assert got == want | dict.fromkeys(("lost", "to lost", "nothing"), (None, None, "missing"))
    # distances up to 1, 3, 7 and 15 end; then one more step finds that the circle stays
    assert steps == [219, 17, 15, 12, 8, 6]


@pytest.mark.parametrize("most", [0, 100_000])
def test_references_resolve_by_shuffle_and_by_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(refs, "BROADCAST_ROWS", most)
    rows = [("a", "1", None), ("b", None, "a"), ("c", None, "b"), ("d", None, "c"), ("e", None, "e"), ("f", None, "gone"), ("g", None, "f")]
    got = {r["name"]: (r["oid"], r["hops"], r["state"]) for r in refs.resolve(spark.createDataFrame(rows, "name string, oid string, ref string")).collect()}
    assert got == {"a": ("1", 0, "ok"), "b": ("1", 1, "ok"), "c": ("1", 2, "ok"), "d": ("1", 3, "ok"), "e": (None, None, "cycle"), "f": (None, None, "missing"), "g": (None, None, "missing")}
