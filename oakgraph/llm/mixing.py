"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words by weight; a
source's target stops at MAX_EPOCHS times its size and the excess is shared again by weight.

Within a source, complete epochs come first: every document is taken as often as the target holds the whole
source. The rest is filled with documents in the order of their exponential keys, -ln(u) / w, where w is the
document's quality weight and u a uniform number from a hash of its id: a document is taken once more while
the middle of its words lies within the rest, so that a source ends within half a document of its target.

The middles grow along the order, so what a source takes of its rest is a prefix, given by one place in the order.
To find it no source is sorted in one task: keys fall into buckets by their own value, running sums over bucket
totals (one row for each source and bucket) find the bucket where the rest ends, and only that one is sorted. Buckets are even
whatever the weights: a source's weights are counted in classes, a quarter of an octave wide, and a key's bucket is its place in
the distribution that exponential keys with these weights have.
Documents then compare their own place with that of their source; texts are never shuffled.

Defined cases: a null text has size 0 and is never taken; null sources form one source; documents that
share an id are ordered by size and a hash of their text, and equal rows are taken alike; a null id is a value like
any other; a null, zero, negative or non-finite weight counts as the least, LEAST_WEIGHT; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import unused

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Weights lie between this and its reciprocal, which makes 160 classes of weights at most.
LEAST_WEIGHT = 2.0**-20
#: Rows of a source that fall into one bucket, about.
BUCKET_ROWS = 2_000
#: Broadcast bucket totals up to so many rows (about 100 bytes each).
BROADCAST_ROWS = 200_000
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for texts without symbols, down to 0.05 where a fifth of the characters are symbols."""
    chars = F.greatest(F.length(text), F.lit(1))
    marks = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * marks / chars), F.lit(1.0))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the MD5 of seed and id; 48 bits."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds weight and target.

    Sources reach their limits in the order of limit / weight. If the first k of them stop there, each other
    target is its weight times (all words - limits of the k) / (weights of the others); a source stops if its
    limit lies below what the sources from it on would get.
    """
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    df = sizes.withColumn("weight", cycle).withColumn("limit", max_epochs * F.col("source_size"))
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(rest)
    df = df.withColumn("level", level).withColumn("stops", F.col("limit") <= F.col("weight") * F.col("level"))
    free = F.min(F.when(~F.col("stops"), F.struct((F.col("limit") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(Window.partitionBy())["level"]
    target = F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.col("weight") * free)
    return df.select("source", "source_size", "weight", target.alias("target"))


def usable(weight: Column) -> Column:
    """The weight, within its bounds."""
    w = weight.cast("double")
    return F.when((w > LEAST_WEIGHT) & (w < float("inf")), F.least(w, F.lit(1 / LEAST_WEIGHT))).otherwise(F.lit(LEAST_WEIGHT))


def keyed(seed: str, weight: Column | None) -> list[Column]:
    """Source, size and the parts of the order of a document, and the class of its weight."""
    w = quality_weight(F.col("text")) if weight is None else usable(weight)
    key = -F.log(uniform(F.col("doc_id"), seed)) / w
    return [F.col("source"), size_of(F.col("text")).alias("size"), key.alias("key"), F.col("doc_id"), F.xxhash64("text").alias("text_key"), F.rint(4 * F.log2(w)).cast("int").alias("weight_class")]


def bucket_of(key: Column, buckets: Column, classes: Column) -> Column:
    """Grows with the key; classes: an array of (w, share), the weights of the source and their shares of its rows."""
    below = F.aggregate(classes, F.lit(0.0), lambda held, c: held + c["share"] * (1 - F.exp(-key * c["w"])))
    return F.least(F.floor(below * buckets), buckets - 1).cast("int")


def place(row: str) -> Column:
    """A document's place in the order of its source."""
    return F.struct(F.col(f"{row}.key"), F.col(f"{row}.doc_id"), F.col(f"{row}.size"), F.col(f"{row}.text_key"))


def small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if it has BROADCAST_ROWS rows at most; df is a written table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def cutoffs(rows: DataFrame) -> DataFrame:
    """rows: written keyed() columns. For each source: source_size, target, epochs, and the place up to which the fractional
    part takes documents: all buckets before ``last``, and in that one the places up to ``cut``."""
    held = rows.groupBy("source", "weight_class").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    seen = F.sort_array(F.collect_list(F.struct(F.pow(F.lit(2.0), F.col("weight_class") / 4).alias("w"), "n")))  # a row for each class
    sources = held.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"), seen.alias("seen"))
    shares = F.transform("seen", lambda c: F.struct(c["w"].alias("w"), (c["n"] / F.col("n")).alias("share")))
    sources = sources.select("source", "source_size", "n", shares.alias("classes"))
    number_of_sources = sources.count()
    goal = targets(sources.select("source", "source_size"))
    number = F.least(F.lit(1 << 20), F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS))).cast("int")
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(MAX_EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    goal = goal.alias("g").join(sources.select("source", number.alias("buckets"), "classes").alias("s"), F.expr("g.source <=> s.source")).select("g.*", "s.buckets", "s.classes")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("epochs") >= MAX_EPOCHS, F.lit(0.0)).otherwise(F.col("target") - F.col("epochs") * F.col("source_size")))
    goal = small(materialize(goal, "mix-sources", number_of_sources))
    dealt = rows.alias("r").join(goal.alias("g"), F.expr("r.source <=> g.source")).select("r.*", bucket_of(F.col("r.key"), F.col("g.buckets"), F.col("g.classes")).alias("bucket"), "g.rest")
    totals = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.first("rest").alias("rest"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("held").over(ahead), F.lit(0)))
    border = totals.where("base <= rest and rest < base + held").groupBy("source").agg(F.max(F.struct("bucket", "base")).alias("b"))
    border = small(materialize(border.select("source", F.col("b.bucket").alias("last"), F.col("b.base").alias("base")), "mix-borders", number_of_sources))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    close = dealt.alias("d").join(border.alias("b"), F.expr("d.source <=> b.source and d.bucket = b.last")).select("d.*", "b.base")
    close = close.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).where(2 * F.col("before") + F.col("size") <= 2 * F.col("rest"))
    cut = close.alias("c").groupBy("source").agg(F.max(place("c")).alias("cut"))
    out = goal.alias("g").join(border.alias("b"), F.expr("g.source <=> b.source"), "left").join(cut.alias("c"), F.expr("g.source <=> c.source"), "left")
    return out.select("g.source", "g.source_size", "g.target", "g.epochs", "g.buckets", "g.classes", F.coalesce("b.last", F.lit(-1)).alias("last"), "c.cut")


def copies(row: str, cut: str) -> Column:
    """How often the mix takes a document."""
    bucket = bucket_of(F.col(f"{row}.key"), F.col(f"{cut}.buckets"), F.col(f"{cut}.classes"))
    last = F.col(f"{cut}.last")
    extra = (bucket < last) | ((bucket == last) & F.coalesce(place(row) <= F.col(f"{cut}.cut"), F.lit(False)))
    return F.when(F.col(f"{row}.size") > 0, F.col(f"{cut}.epochs") + extra.cast("long")).otherwise(0).cast("long")


def plan(docs: DataFrame, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each document; texts are read once. weight: a column of docs
    that grows with a document's quality; without it quality_weight() of the text."""
    rows = materialize(docs.select(*keyed(seed, weight)), "mix-keys")
    cuts = small(materialize(cutoffs(rows), "mix-cutoffs", rows.select("source").distinct().count()))
    taken = copies("r", "c") * F.col("r.size")
    return rows.alias("r").join(cuts.alias("c"), F.expr("r.source <=> c.source")).select("r.doc_id", "r.size", "c.source_size", "c.target", taken.alias("taken"))


def mix(docs: DataFrame, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; texts are read twice and not shuffled. weight as in plan()."""
    keys = materialize(docs.select(*keyed(seed, weight)), "mix-keys")
    cuts = small(materialize(cutoffs(keys), "mix-cutoffs", keys.select("source").distinct().count()))
    k, n = unused("mix_key", docs), unused("mix_copy", docs)
    rows = docs.withColumn(k, F.struct(*keyed(seed, weight))).alias("d").join(cuts.alias("c"), F.expr(f"d.`{k}`.source <=> c.source"))
    each = rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.lit(MAX_EPOCHS)))).where(F.col(n) <= copies(f"d.{k}", "c"))
    return each.select(*[F.col(f"d.`{c}`") for c in docs.columns])
