"""Walks, folds and limits against brute force."""

import hashlib
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from oakgraph import runtime
from oakgraph.operators import graph, refs, trees
from oakgraph.plans import model
from oakgraph.streaming import packets


def reached(edges, root):
    seen, todo = {root}, [root]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_fold_over_what_each_root_reaches(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)]
    df = spark.createDataFrame(edges, "src string, dst string")
    roots = [f"n{i}" for i in range(0, 30, 4)]
    pairs = graph.reach_from_each(df, spark.createDataFrame([(r,) for r in roots * 2], "root string"))
    assert sorted((r["root"], r["node"]) for r in pairs.collect()) == sorted((r, n) for r in roots for n in reached(edges, r))
    objects = spark.createDataFrame([(f"n{i}", "blob" if i % 3 else "tree", i) for i in range(30)], "oid string, kind string, size long")
    got = {r["root"]: (r["largest"], r["n"]) for r in trees.fold(objects, pairs, F.max("size").alias("largest"), F.count(F.lit(1)).alias("n"), by=("root",)).collect()}
    found = {r: reached(edges, r) for r in roots}
    assert got == {r: (max(int(n[1:]) for n in s), len(s)) for r, s in found.items()}
    counted = {(r["root"], r["kind"]): (r["n"], r["total"]) for r in trees.fold(objects, pairs).collect()}
    for (r, kind), (n, total) in counted.items():
        held = [int(x[1:]) for x in reached(edges, r) if (int(x[1:]) % 3 > 0) == (kind == "blob")]
        assert (n, total) == (len(held), sum(held))


def test_commits_and_their_parents(spark):
    rows = [("a", None, 10, "u"), ("b", "a", 20, "u"), ("c", "b", 20, "v"), ("d", "gone", 90, "v")]
    commits = spark.createDataFrame(rows, "node string, parent string, ts long, who string")
    links = graph.commit_graph(commits)
    assert sorted((r["src"], r["dst"]) for r in links.collect()) == [("b", "a"), ("c", "b")]
    got = sorted((r["node"], r["parent"], r["parent_ts"]) for r in graph.with_parents(links, commits, "ts").collect())
    assert got == [("b", "a", 10), ("c", "b", 20)]
    assert sorted(r["node"] for r in graph.newer_than(commits, 70).collect()) == ["b", "c", "d"]
    assert sorted((r["node"], r["place"]) for r in graph.date_order(commits, "who").collect()) == [("a", 1), ("b", 2), ("c", 1), ("d", 2)]
    assert graph.newer_than(commits.limit(0), 5).count() == 0


def test_what_a_push_sends(spark):
    """Commands, limits and the difference between both sides, chained."""
    edges = spark.createDataFrame([("c3", "c2"), ("c2", "c1"), ("x2", "x1"), ("x1", "c1")], "src string, dst string")
    ref = lambda *rows: spark.createDataFrame(rows, "name string, oid string")
    local, remote = ref(("main", "c3"), ("topic", "x2")), ref(("main", "c1"), ("old", "x1"))
    commands = spark.createDataFrame([("update", "main", "main"), ("create", "topic", "topic"), ("delete", "old", "old")], "op string, src string, dst string")
    plan = refs.push_plan(commands, local, remote)
    sources, exclude = refs.push_limits(plan, remote)
    assert {r["node"] for r in sources.collect()} == {"c3", "x2"} and {r["node"] for r in exclude.collect()} == {"c1", "x1"}
    assert {r["node"] for r in graph.difference(edges, sources, exclude).collect()} == {"c3", "c2", "x2"}


def test_a_tree_of_thirty_thousand_entries(spark):
    names = [f"file{i}" for i in range(30_000)]
    node = lambda n: hashlib.sha1(n.encode()).hexdigest()
    files = spark.createDataFrame([(n, "100644", node(n)) for n in names], "path string, perm string, node string").repartition(5)
    raw = b"".join(b"100644 " + n.encode() + b"\0" + bytes.fromhex(node(n)) for n in sorted(names))
    root = trees.write_trees(files).where("path = ''").first()
    assert root["oid"] == hashlib.sha1(b"tree %d\0" % len(raw) + raw).hexdigest() and root["size"] == len(raw)


@pytest.mark.parametrize("pieces", [2, 3])
def test_walks_merge_what_they_saw(spark, monkeypatch, pieces):
    monkeypatch.setattr(graph, "PIECES", pieces)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(11)] + [("n3", "n7"), ("n0", "x"), ("y", "n9")]
    df = spark.createDataFrame(edges, "src string, dst string")
    one = lambda n: spark.createDataFrame([(n,), (n,)], "node string")
    got = {r["node"]: r["level"] for r in graph.reach(df, one("n0")).collect()}
    assert got == {f"n{i}": i if i < 7 else i - 3 for i in range(12)} | {"x": 1}
    assert {r["node"] for r in graph.difference(df, one("n0"), one("y")).collect()} == {f"n{i}" for i in range(9)} | {"x"}
    # with a depth what is known may lead on to what is not
    assert {r["node"] for r in graph.difference(df, one("n3"), one("n4"), max_depth=2).collect()} == {"n3", "n7", "n8"}
    levels = {r["node"]: r["level"] for r in graph.topological_levels(df, spark.createDataFrame([(n,) for n in {x for e in edges for x in e}], "node string")).collect()}
    assert levels == {f"n{i}": i for i in range(12)} | {"x": 1, "y": 0}
    cut = {r["node"]: r["shallow"] for r in graph.deepen_not(df, one("n5"), one("y")).collect()}
    assert cut == {"n5": False, "n6": False, "n7": False, "n8": True}


def plans_of_steps(monkeypatch):
    """The plans of the tables that graph queries write, as they are written, by label."""
    plans = []

    def noted(df, label, *rest):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return runtime.materialize(df, label, *rest)

    monkeypatch.setattr(graph, "materialize", noted)
    return plans


DAG = [("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d1"), ("c", "d2"), ("d1", "e"), ("x", "d2"), ("x", "x1")]


def test_levels_of_what_has_edges(spark, monkeypatch):
    plans = plans_of_steps(monkeypatch)
    df = runtime.materialize(spark.createDataFrame(DAG, "src string, dst string"), "dag")
    got = {r["node"]: r["level"] for r in graph.topological_levels(df).collect()}
    assert got == {"a": 0, "x": 0, "b": 1, "x1": 1, "c": 2, "d1": 3, "d2": 3, "e": 4}
    # a step reads the edges that may leave its nodes, and makes its targets distinct, not the edges as well
    steps = [p for label, p in plans if label == "levels"][1:]
    assert len(steps) == 5 and all(p.count("Aggregate") == 1 and p.count("src#") and ">= " in p and "<= " in p for p in steps)
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_levels(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string"))
    assert graph.topological_levels(df.limit(0)).count() == 0


def test_closure_without_a_store_takes_all_as_present(spark, monkeypatch):
    plans = plans_of_steps(monkeypatch)
    df = runtime.materialize(spark.createDataFrame(DAG, "src string, dst string"), "dag")
    node = lambda *ns: spark.createDataFrame([(n,) for n in ns], "node string")
    nodes, turned = graph.closure(df, None, node("c", "lone"), node("a"))
    assert sorted(r["node"] for r in nodes.collect()) == ["a", "b", "c", "lone"]
    assert sorted(map(tuple, turned.collect())) == [("b", "a"), ("c", "a"), ("c", "b")]
    assert graph.closure(df, None, node("c"), node("a"), inside=False)[1] is None
    # what is low, and whether it is there, is looked up once, and not by each step of the walk
    plans.clear()
    present = spark.range(1).select(F.explode(F.array(*map(F.lit, "abcxe"))).alias("node"))
    nodes, turned = graph.closure(df, present, node("c", "lone"), node("a", "d1"))
    assert sorted(r["node"] for r in nodes.collect()) == ["a", "b", "c"]
    assert sorted(map(tuple, turned.collect())) == [("b", "a"), ("c", "a"), ("c", "b")]
    steps = [p for label, p in plans if label in ("reach", "met")][1:]
    assert len(steps) >= 4 and not any("Generate" in p for p in steps)


def test_limits_meet_only_the_edges_of_the_walk(spark, monkeypatch):
    plans = plans_of_steps(monkeypatch)
    df = runtime.materialize(spark.createDataFrame(DAG, "src string, dst string"), "dag")
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    cut = graph.deepen_not(df, one("a"), one("x"))
    assert {r["node"]: r["shallow"] for r in cut.collect()} == {"a": False, "b": False, "c": True, "d1": False, "e": False}
    assert "dag-" not in "".join(cut.inputFiles()) and any(label == "met" for label, _ in plans)


@pytest.mark.parametrize("keep", [False, True])
def test_walks_of_edges_that_repeat_and_of_nodes_of_any_type(spark, keep):
    df = spark.createDataFrame([(1, 20), (1, 20), (20, 3), (3, 1), (20, 400), (7, 8)], "src long, dst long")
    nodes, met = graph.walk(df, spark.createDataFrame([(1,)], "node long"), keep=keep)
    assert sorted(map(tuple, nodes.collect())) == [(1, 0), (3, 2), (20, 1), (400, 2)]
    assert met is None if not keep else sorted(map(tuple, met.distinct().collect())) == [(1, 20), (3, 1), (20, 3), (20, 400)]


def test_merged_pieces_stay_few(spark, monkeypatch):
    monkeypatch.setattr(graph, "PIECES", 3)
    one = spark.createDataFrame([("a",)], "node string")
    seen = graph.Seen(one)
    for _ in range(25):
        seen.add(one)
    assert [rank for rank, _ in seen.pieces] == [2, 2, 1, 1, 0, 0] and seen.all().count() == 26


def test_shallow_lines_are_applied(spark):
    shallow = spark.createDataFrame([("a",), ("b",), ("c",)], "oid string")
    lines = spark.createDataFrame([("unshallow", "a", 1), ("unshallow", "b", 1), ("shallow", "b", 2), ("shallow", "d", 1), ("unshallow", "e", 1), ("ack", "c", 3)], "type string, oid string, seq int")
    assert sorted(r["oid"] for r in graph.apply_shallow(shallow, lines).collect()) == ["b", "c", "d"]
    assert graph.apply_shallow(shallow.limit(0), lines.limit(0)).count() == 0


def test_messages_as_they_are_sent(spark):
    a, b, z = "a" * 40, "b" * 40, "0" * 40
    rows = [
        ("want", a, "ofs-delta", None, f"want {a} ofs-delta\n"), ("have", a, None, None, f"have {a}\n"), ("shallow", a, None, None, f"shallow {a}\n"), ("unshallow", a, None, None, f"unshallow {a}\n"),
        ("ack", a, "common", None, f"ACK {a} common\n"), ("ack", a, None, None, f"ACK {a}\n"), ("nak", None, None, None, "NAK\n"), ("done", None, None, None, "done\n"), ("deepen", None, "3", None, "deepen 3\n"),
        ("unpack", None, "ok", None, "unpack ok\n"), ("ok", None, "refs/x", None, "ok refs/x\n"), ("ng", None, "refs/x no", None, "ng refs/x no\n"), ("create", a, "refs/é", None, f"{z} {a} refs/é"),
        ("delete", a, "refs/x", None, f"{a} {z} refs/x"), ("update", a, "refs/x", b, f"{b} {a} refs/x"), ("flush", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "type string, oid string, detail string, old string, line string")
    sent = packets.encode_messages(df)
    for r in sent.collect():
        raw = b"0000" if r["line"] is None else b"%04x" % (len(r["line"].encode()) + 4) + r["line"].encode()
        assert bytes(r["packet"]) == raw
    got = packets.decode_messages(sent.drop("line").withColumn("n", F.lit(1)))
    assert sorted(map(str, ((r["type"], r["oid"], r["detail"]) for r in got.collect()))) == sorted(str(r[:3]) for r in rows)
    with pytest.raises(Exception, match="no line for update"):
        packets.encode_messages(df.drop("old")).collect()


def test_what_a_step_wrote_on_its_way_goes(spark):
    made = []

    def step():
        part = runtime.materialize(spark.range(5), "part")
        made.extend(part.inputFiles())
        return part.where("id > 1")

    def outer():
        inner = runtime.written(spark, step, "inner")
        made.extend(inner.inputFiles())
        return inner

    df = runtime.written(spark, outer, "outer")
    assert sorted(r["id"] for r in df.collect()) == [2, 3, 4]
    assert made and not any(pathlib.Path(f.removeprefix("file://")).exists() for f in made)


def test_edges_of_the_shared_graph_are_distinct_by_number(spark, sf):
    """Lines are made distinct before names are made of their numbers, and not at all for walks; with both the edges are the same."""
    edges = model.star(spark, sf)
    groups = [x.split("], [")[0] for x in edges._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert len(groups) == 2 and all("Aggregate [l_orderkey#" in x for x in groups)
    again = model.star(spark, sf, repeats=True)
    assert "Aggregate" not in again._jdf.queryExecution().optimizedPlan().toString()
    assert again.count() > edges.count() == again.distinct().count() and edges.exceptAll(again.distinct()).isEmpty()


def test_present_edges_look_up_targets_first(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "x"), ("y", "b"), ("b", None), (None, "a")], "src string, dst string")
    got = graph.present_edges(edges, spark.createDataFrame([("a",), ("b",), ("b",)], "node string"))
    assert sorted(map(tuple, got.select("src", "dst").collect())) == [("a", "b"), ("a", "b")]
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftSemi" in x]
    assert len(joins) == 2 and "src#" in joins[0] and "dst#" in joins[1]  # the inner join comes last


def test_edges_beyond_the_range_of_present_nodes_are_left_out_before_any_shuffle(spark, sf):
    nodes = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    got = graph.present_edges(model.star(spark, sf), nodes("c1", "o5", "c3", None, "c3"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = [x.split("Relation")[0] for x in plan.split("Aggregate [l_orderkey#")[1:]]
    assert len(below) == 2 and all(f"(concat({c}, cast(l_" in x and ">= c1)" in x and "<= o5)" in x for x, c in zip(below, "ps", strict=True))
    edges = spark.createDataFrame([("c1", "o5"), ("c1", "o5"), ("c3", "c1"), ("c1", "p1"), ("b", "c1"), ("c1", "c2"), ("c1", None), (None, "c1"), ("o5", "o5")], "src string, dst string")
    assert sorted(map(tuple, graph.present_edges(edges, nodes("c1", "o5", "c3", None, "c3")).select("src", "dst").collect())) == [("c1", "o5"), ("c1", "o5"), ("c3", "c1"), ("o5", "o5")]
    assert graph.present_edges(edges, nodes()).isEmpty() and graph.present_edges(edges, nodes(None)).isEmpty()
