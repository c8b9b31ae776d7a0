"""Connected components of an edge table, with large-star and small-star steps.

Each step points the neighbours of a node at the smallest of them; a star remains for each component after a
number of steps that grows with the logarithm of its size. Steps are written to the shared folder, so plans stay
short and a lost executor costs a re-read. Rows of a node with very many neighbours are dealt to many tasks.

Defined cases: edges with a null end and loops are left out; repeated edges, in either direction, count once; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import attach


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), a written table. Returns (node, component), the smallest node reachable, for each node of an edge; loops are left out."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = _state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m")).select("u", "n", F.least("u", "m").alias("m"))
        large = attach(both, materialize(least, "least", 2 * state[0]), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(near.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges", 2 * state[0])
        before, state = state, _state(edges)
        if state == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
