"""Trees: canonical order, roll-up of paths into tree objects, edges, path lookup."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import objects as O
from ..runtime import materialize


def ordered(entries: DataFrame, group: str = "tree") -> DataFrame:
    """entries (group, perm, name, node) with pos, the place in canonical order."""
    key = O.entry_key(F.col("perm"), F.col("name"))
    return entries.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1)


def add(entries: DataFrame, new: DataFrame, group: str = "tree") -> DataFrame:
    """entries with those of new put in; a new entry replaces one of the same name, whether file or directory."""
    kept = entries.join(new.select(group, "name"), [group, "name"], "left_anti")
    return kept.select(group, "perm", "name", "node").unionByName(new.select(group, "perm", "name", "node"))


def remove(entries: DataFrame, gone: DataFrame, group: str = "tree") -> DataFrame:
    """entries without those named in gone (group, name); names that are not there do no harm."""
    return entries.join(gone.select(group, "name"), [group, "name"], "left_anti")


def tree_ids(entries: DataFrame, group: str = "tree") -> DataFrame:
    """(group, oid, n_entries, size) of the tree that each group's entries make.

    The entries of a tree are sorted by Spark, which spills, and hashed as they pass by, so no row or task holds a whole tree.
    """
    part = O.tree_entry(F.col("perm"), F.col("name"), F.col("node"))
    rows = entries.select(F.col(group).alias("tree"), F.coalesce(O.entry_key(F.col("perm"), F.col("name")), F.lit(b"")).alias("k"), part.alias("p"))
    rows = materialize(rows, "entries")
    sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.sum(F.octet_length("p")), F.lit(0)).cast("long").alias("size"))
    heads = sizes.select("tree", F.lit(None).cast("binary").alias("k"), O.header("tree", F.col("size")).alias("p"), "n_entries", "size")
    rest = rows.where("p is not null").select("tree", "k", "p", F.lit(None).cast("long").alias("n_entries"), F.lit(None).cast("long").alias("size"))
    dealt = heads.unionAll(rest).repartition("tree").sortWithinPartitions("tree", F.asc_nulls_first("k"), "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # group, number, size, digest

        def row(held) -> pa.RecordBatch:
            name, number, size, digest = held
            return pa.record_batch([pa.array([name], kind), pa.array([digest.hexdigest()]), pa.array([number], pa.int64()), pa.array([size], pa.int64())], names=[group, "oid", "n_entries", "size"])

        for batch in batches:
            kind = batch.column(0).type
            for name, k, p, number, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k is None:  # a header, which goes before the entries of its tree
                    if held:
                        yield row(held)
                    held = (name, number, size, hashlib.sha1(p))
                else:
                    held[3].update(p)
        if held:
            yield row(held)

    return dealt.mapInArrow(run, T.StructType([T.StructField(group, entries.schema[group].dataType), T.StructField("oid", T.StringType()), T.StructField("n_entries", T.LongType()), T.StructField("size", T.LongType())]))


def write_trees(files: DataFrame) -> DataFrame:
    """files (path, perm, node): a row for each staged file. Returns (path, perm, name, parent, oid, depth, size): every directory from
    the leaves to the root (path '') as a tree object, and every file; rolled up one depth at a time, deepest first."""
    last = F.element_at(F.split("path", "/"), -1)
    up = F.when(F.instr("path", "/") > 0, F.expr("left(path, length(path) - length(element_at(split(path, '/'), -1)) - 1)")).otherwise(F.lit(""))
    leaf = files.select("path", "perm", last.alias("name"), up.alias("parent"), F.col("node").alias("oid"), F.size(F.split("path", "/")).alias("depth"), F.lit(None).cast("long").alias("size"))
    leaf = materialize(leaf, "staged")
    deepest = leaf.agg(F.max("depth")).first()[0] or 0
    done, level = leaf, leaf.where(F.col("depth") == deepest)
    for depth in range(deepest - 1, -1, -1):
        trees = tree_ids(level.select(F.col("parent").alias("path"), "perm", "name", "oid").withColumnRenamed("oid", "node"), "path")
        rows = trees.select("path", F.lit("40000").alias("perm"), last.alias("name"), up.alias("parent"), "oid", F.lit(depth).alias("depth"), "size")
        rows = materialize(rows, "trees")
        done = done.unionByName(rows)
        level = rows.unionByName(leaf.where(F.col("depth") == depth)) if depth else rows
    return done


def edges(written: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, label) of the trees from write_trees(); equal trees give theirs once."""
    parent = written.where("perm = '40000'").select(F.col("path").alias("parent"), F.col("oid").alias("src"))
    below = written.where("path <> ''").select("parent", F.col("oid").alias("dst"), F.col("name").alias("label"))
    return below.join(parent, "parent").select("src", "dst", F.lit("entry").alias("kind"), "label").distinct()


def find(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (qid, root, path) resolved against edges (src, dst, label): one equi-join for each segment, for all queries at once.

    Returns (qid, oid), null where a segment is missing; an empty path gives the root.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    open_rows = materialize(queries.select("qid", F.col("root").alias("oid"), parts.alias("parts")), "paths")
    longest = open_rows.agg(F.max(F.size("parts"))).first()[0] or 0
    step = entries.select("src", "label", "dst").distinct()
    for i in range(longest):
        here = open_rows.withColumn("segment", F.get("parts", F.lit(i)))
        moved = here.join(step, (F.col("oid") == F.col("src")) & (F.col("segment") == F.col("label")), "left")
        open_rows = moved.select("qid", F.when(F.col("segment").isNull(), F.col("oid")).otherwise(F.col("dst")).alias("oid"), "parts")
    return open_rows.select("qid", "oid")


def fold(objects: DataFrame, reached: DataFrame, *aggregates: Column, by: tuple[str, ...] = ("root", "kind")) -> DataFrame:
    """Aggregates over the objects (oid, kind, size, more) that each root reaches, the caller's or their number and bytes (n, total);
    reached: (root, node), each pair once, as of graph.reach_from_each()."""
    aggregates = aggregates or (F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("total"))
    return reached.join(objects.withColumnRenamed("oid", "node"), "node").groupBy(*by).agg(*aggregates)


def to_dot(links: DataFrame, kinds: DataFrame) -> DataFrame:
    """(line): edges as Graphviz lines; kinds: (oid, kind). Nodes are `C-`, `Tr-`, `Ta-` or `B-` and eight digits."""
    prefix = F.create_map(*(F.lit(x) for pair in {"commit": "C-", "tree": "Tr-", "tag": "Ta-", "blob": "B-"}.items() for x in pair))
    named = kinds.select("oid", F.concat(prefix[F.col("kind")], O.short_id(F.col("oid"))).alias("dot"))
    a, b = named.select(F.col("oid").alias("src"), F.col("dot").alias("a")), named.select(F.col("oid").alias("dst"), F.col("dot").alias("b"))
    return links.join(a, "src").join(b, "dst").select(F.format_string('"%s" -> "%s" [label="%s"];', "a", "b", "label").alias("line"))
