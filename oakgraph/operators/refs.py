"""References: layers, resolution, upserts, and plans for exchanging them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import objects as O
from ..runtime import materialize


def layered(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """(name, oid, ref, layer): loose (name, oid, ref) over packed (name, oid)."""
    under = packed.select("name", F.col("oid").alias("packed_oid"))
    both = loose.withColumn("own", F.lit(True)).join(under, "name", "full")
    oid = F.when(F.col("own"), F.col("oid")).otherwise(F.col("packed_oid"))
    return both.select("name", oid.alias("oid"), "ref", F.when(F.col("own"), F.lit("loose")).otherwise(F.lit("packed")).alias("layer"))


#: Rows that may go to all executors while references are followed; more are shuffled.
BROADCAST_ROWS = 100_000


def resolve(refs: DataFrame) -> DataFrame:
    """(name, oid, hops, state): refs (name, oid, ref) followed to an object; state is ok, missing or cycle.

    Each step doubles the distance followed, so a chain of n references takes log2(n) joins, and reads what is open alone against all. A step that
    ends nowhere new tells that the rest are cycles: a longer chain would have names at each distance from its end.
    """
    held = refs.select("name", F.col("ref").alias("at"), "oid", F.when(F.col("ref").isNull(), 0).otherwise(1).alias("hops"))
    held = materialize(held, "refs")
    done, fresh = held.where("at is null"), held.where("at is not null")
    ended, span, most, left = [done], 1, held.count(), fresh.count()
    while left and span <= most:
        ahead = reduce(DataFrame.unionAll, [*ended, fresh])
        ahead = ahead.select(F.col("name").alias("at"), F.col("at").alias("next"), F.col("oid").alias("next_oid"), F.col("hops").alias("more"), F.lit(True).alias("there"))
        if left <= BROADCAST_ROWS:
            ahead = ahead.join(F.broadcast(fresh.select("at")), "at", "left_semi")
        moved = fresh.join(ahead if left <= BROADCAST_ROWS else ahead.hint("merge"), "at", "left")
        hit = F.col("there").isNotNull()
        moved = moved.select("name", F.when(hit, F.col("next")).alias("at"), F.coalesce("oid", "next_oid").alias("oid"), (F.col("hops") + F.when(hit, F.col("more")).otherwise(0)).alias("hops"))
        moved = materialize(moved, "refs")
        ended.append(moved.where("at is null"))
        fresh, span, before = moved.where("at is not null"), span * 2, left
        left = fresh.count()
        if left == before and fresh.where("oid is not null").isEmpty():
            break
    state = lambda other: F.when(F.col("oid").isNotNull(), F.lit("ok")).otherwise(F.lit(other))
    rows = reduce(DataFrame.unionAll, [*(df.withColumn("state", state("missing")) for df in ended), fresh.withColumn("state", state("cycle"))])
    return rows.select("name", "oid", F.when(F.col("oid").isNotNull(), F.col("hops")).alias("hops"), "state")


def upsert(refs: DataFrame, writes: DataFrame) -> DataFrame:
    """refs (name, oid) after writes (name, oid, seq); of several writes the last wins, and a null id deletes."""
    last = writes.groupBy("name").agg(F.max_by(F.struct("oid"), F.struct("seq", "oid")).alias("w"))
    both = refs.withColumnRenamed("oid", "old").join(last, "name", "full")
    return both.select("name", F.when(F.col("w").isNotNull(), F.col("w.oid")).otherwise(F.col("old")).alias("oid")).where("oid is not null")


def newest(candidates: DataFrame, group: str, ts: str, oid: str) -> DataFrame:
    """(group, ts, oid): the newest of each group; ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(ts), F.asc(oid)))
    return candidates.withColumn("rank_", rank).where("rank_ = 1").select(group, ts, oid)


def wanted(advertised: DataFrame, names: DataFrame | None) -> DataFrame:
    """Advertised (oid, name, peeled) that a fetch asks for: the named ones, or without names all that are no tags; peeled ones never."""
    plain = advertised.where(~F.col("peeled"))
    if names is None:
        return plain.where(~F.array_contains(F.split("name", "/"), "tags"))
    return plain.join(names.select("name").distinct(), "name", "left_semi")


def wants(remote: DataFrame, local: DataFrame) -> DataFrame:
    """(oid): remote ids that are not here, each once."""
    return remote.select("oid").distinct().join(local.select("oid"), "oid", "left_anti")


def map_refspecs(sources: DataFrame, specs: DataFrame) -> DataFrame:
    """(src, dst): where each source name goes; specs (src, dst) may name several, without one it keeps its name."""
    return sources.select(F.col("name").alias("src")).join(specs, "src", "left").select("src", F.coalesce("dst", "src").alias("dst")).distinct()


def push_plan(commands: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """commands (op, src, dst): op create, delete or update. Returns (op, dst, old_oid, new_oid) of those that can be done: create and update need
    the local name, delete the remote one; an update of what is not there is a create."""
    rows = commands.join(local.select(F.col("name").alias("src"), F.col("oid").alias("new")), "src", "left").join(remote.select(F.col("name").alias("dst"), F.col("oid").alias("old")), "dst", "left")
    op = F.when((F.col("op") == "delete") & F.col("old").isNotNull(), F.lit("delete"))
    op = op.when(F.col("op").isin("create", "update") & F.col("new").isNotNull(), F.when((F.col("op") == "update") & F.col("old").isNotNull(), F.lit("update")).otherwise(F.lit("create")))
    rows = rows.withColumn("op", op).where("op is not null")
    return rows.select("op", "dst", F.when(F.col("op") != "create", F.col("old")).alias("old_oid"), F.when(F.col("op") != "delete", F.col("new")).alias("new_oid"))


def empty_commits(branches: DataFrame, commits: DataFrame, who: Column, message: Column) -> DataFrame:
    """(name, parent, tree, raw, oid): for each of branches (name, oid), resolved, a commit without changes, which has the tree of the
    branch's commit and that commit as its parent; branches without one in commits (oid, tree) are left out. With a seq the rows are
    writes for upsert()."""
    heads = branches.join(commits.select("oid", "tree"), "oid").withColumnRenamed("oid", "parent")
    none = F.array().cast("array<struct<key:string,lines:array<string>>>")
    raw = O.commit_payload(F.col("tree"), F.array("parent"), who, who, none, message)
    return heads.select("name", "parent", "tree", raw.alias("raw")).withColumn("oid", O.object_id("commit", F.col("raw")))


def push_limits(plan: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node) of sources and of exclude: new ids, and what the other side has."""
    sources = plan.where("new_oid is not null").select(F.col("new_oid").alias("node")).distinct()
    exclude = remote.select(F.col("oid").alias("node")).union(plan.where("old_oid is not null").select(F.col("old_oid"))).distinct()
    return sources, exclude


def next_flush(count: int, stateless: bool) -> int:
    """Haves before the next flush: from 16 on doubled up to 32, or without a connection up to 16384 and then by a tenth more."""
    if not stateless:
        return count * 2 if count < 32 else count + 32
    return count * 2 if count < 16384 else count * 11 // 10


def push_status(lines: DataFrame) -> DataFrame:
    """lines (push, line): `unpack ok`, `ok <ref>`, `ng <ref> <reason>`. Returns (push, n_ok, n_failed, ok): ok unless one failed."""
    bad = (F.startswith("line", F.lit("unpack ")) & (F.col("line") != "unpack ok")) | F.startswith("line", F.lit("ng "))
    return lines.groupBy("push").agg(F.count_if(F.startswith("line", F.lit("ok "))).alias("n_ok"), F.count_if(bad).alias("n_failed"), (~F.bool_or(bad)).alias("ok"))


def complete_thin(received: DataFrame, bases: DataFrame, store: DataFrame) -> DataFrame:
    """(oid, origin): received objects and, from the store, the bases (oid) that they need and did not bring."""
    missing = bases.select("oid").distinct().join(received.select("oid"), "oid", "left_anti")
    added = missing.join(store.select("oid"), "oid", "left_semi")
    return received.select("oid").distinct().withColumn("origin", F.lit("received")).unionByName(added.withColumn("origin", F.lit("store")))
