"""MinHash near-dedup: banded candidates, sequential Bayesian pruning, exact verification.

1. Every whole text becomes a set of word shingles and a signature of BANDS * ROWS minima. Texts with equal
   sets form a class, whose smallest id stands for it; copies are never paired.
2. Representatives that agree on a band share a bucket. A pair at the threshold shares none with a probability
   of (1 - 0.8**5)**32 < 4e-6.
3. Of a bucket, members meet a pivot rather than each other, and only where they are not yet in one component;
   later rounds take other pivots, another one for each bucket. What PIVOT_ROUNDS leave apart is joined by rare shingles: two
   sets at the threshold share one of the 20 % of each that the fewest sets have, and members that share one which at most CROWD of
   them have are paired. Unlike texts with a passage in common, which fill a bucket, have rare shingles of their own and are not.
   Members nearly all of whose shingles are common, and that lie outside the largest component of their bucket, are compared with the
   members like them of other components there, block by block inside tasks, which hand on one link for each member and
   component at most. So no candidate pair is left out that could change a component, and no table of all pairs of a group is made.
4. Signatures of a pair are compared in batches of STEP; after each, the pair is dropped if the posterior
   probability that its similarity reaches the threshold, from a uniform prior, is below MISS.
5. Survivors are verified on the full sets of shingles themselves, not their hashes.
6. Components come from the verified links.

Words are runs of anything but ASCII white space, with A-Z in lower case.

Defined cases: a null text or one without words has an empty set, is linked with nothing and stands for itself; with
fewer words than a shingle has, the sequence of all words is the one shingle; very long texts are hashed whole; rows that share an
id count as one document; rows with a null id are linked with nothing and have a null component; an empty table gives an empty result;
other columns are left out, or kept unchanged by keep_one().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import empty, materialize
from .common import SLICE_CHARS, attach, text_parts, word_codes, words
from .components import components

BANDS, ROWS = 32, 5
STEP = 32
MISS = 1e-6
THRESHOLD = 80  # per cent
PIVOT_ROUNDS = 2
#: Shingles in a block, about; a longer set is a block of its own.
BLOCK_SHINGLES = 250_000
#: Members that share a rare shingle are paired up to so many.
CROWD = 64
#: Pairs of a pivot that one task verifies, about.
PART_PAIRS = 256
#: Broadcast ids or hashes up to so many rows (8 or 16 bytes each).
BROADCAST_ROWS = 200_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(8)
_A = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    names, at, ends = word_codes(pc.ascii_lower(texts))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[at]
    full = np.full(max(0, len(h) - k + 1), k, np.uint64)  # as if all texts were one; what spans two is never looked at
    for j in range(k):
        full = _mix(full ^ h[j : j + len(full)])
    start = 0
    for end in ends.tolist():
        n = end - start
        if n >= k:
            yield np.unique(full[start : end - k + 1])
        else:
            short = np.full(min(n, 1), n, np.uint64)
            for j in range(n):
                short = _mix(short ^ h[start + j])
            yield short
        start = end


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of BANDS * ROWS linear maps on 32 bits."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    parts = [(_A[:, None] * x[i : i + 16_384] + _B[:, None]).min(axis=1) for i in range(0, len(x), 16_384)]
    return parts[0] if len(parts) == 1 else np.minimum.reduce(parts)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, sig) of every whole text; set_hash and sig are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_parts(batches, 1, SLICE_CHARS):
            sizes, sets, sigs = [], [], []
            for hashes in shingle_hashes(texts, k):
                sizes.append(len(hashes))
                sets.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                sigs.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_hash", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, sig binary")


def least_matches(compared: int) -> int:
    """The fewest matches of so many at which the posterior probability of reaching the threshold is MISS or more."""
    t, n = THRESHOLD / 100, compared + 1
    tail = 0.0  # of Beta(m + 1, compared - m + 1) above t: the chance of m or fewer successes of n
    for m in range(compared + 1):
        tail += math.comb(n, m) * t**m * (1 - t) ** (n - m)
        if tail >= MISS:
            return m
    return compared + 1


def prune(pairs: DataFrame) -> DataFrame:
    """(p, q) of the rows (p, q, sig_p, sig_q) that no batch of the signatures rules out."""
    bounds = [(n, least_matches(n)) for n in range(STEP, BANDS * ROWS + 1, STEP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(len(batch), -1) for i in (2, 3))
            live, matched = np.arange(len(batch)), np.zeros(len(batch), np.int64)
            for n, least in bounds:
                matched = matched + (left[live, n - STEP : n] == right[live, n - STEP : n]).sum(axis=1)
                keep = matched >= least
                live, matched = live[keep], matched[keep]
            yield batch.select([0, 1]).take(pa.array(live))

    return pairs.select("p", "q", "sig_p", "sig_q").mapInArrow(run, "p long, q long")


def shingle_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    w = words((text or "").translate(_LOWER))
    if not w:
        return set()
    return set(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else {tuple(w)}


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the documents in ids (id), made from a written table."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")


def verify(rows: DataFrame, k: int) -> DataFrame:
    """(a, b), the smaller id first, of the pairs whose full sets reach the threshold.

    rows: (p, part, q, text), a row with a null q for the text of each p and part, and one for the text of each q that p meets
    there. So the text of a pivot goes once to each of its parts, and not with each of its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for start in range(0, len(batch), 100):
                good = []
                for p, part, q, text in zip(*(c.to_pylist() for c in batch.slice(start, 100).columns), strict=True):
                    y = shingle_set(text, k)
                    if q is None:
                        held = [*held, y] if at == (p, part) else [y]
                        at = p, part
                    elif any(100 * (common := len(x & y)) >= THRESHOLD * (len(x) + len(y) - common) for x in held):
                        good.append((min(p, q), max(p, q)))
                yield pa.record_batch([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = rows.select("p", "part", "q", "text").repartition("p", "part").sortWithinPartitions("p", "part", F.col("q").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def confirm(close: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(a, b) of the pairs (p, q) of close, a written table, that are linked by their full sets. Pairs of one p are dealt to
    tasks by PART_PAIRS."""
    ids = close.select(F.col("p").alias("id")).unionAll(close.select(F.col("q").alias("id"))).distinct()
    texts = texts_of(ids, docs)
    pivots = close.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / PART_PAIRS).cast("int"))
    pivots = materialize(pivots, "dup-pivots")
    part = F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")
    pairs = attach(close, pivots, "p").select("p", part.alias("part"), "q").join(texts.withColumnRenamed("id", "q"), "q")
    heads = pivots.join(texts.withColumnRenamed("id", "p"), "p").select("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("q"), "text")
    return verify(heads.unionByName(pairs), k)


def links(pairs: DataFrame, most: int, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The (a, b) of the (p, q) of pairs, of which there are ``most``, that are linked."""
    for side in "pq":
        pairs = pairs.join(reps.select(F.col("rep").alias(side), F.col("sig").alias(f"sig_{side}")), side)
    return confirm(materialize(prune(pairs), "dup-close", 20 * most), docs, k)


def crossing(lone: pa.Table, crowd: pa.Table) -> pa.Table:
    """Likely links (p, q) of a block of all members and a block of lone ones, one for each lone member q and component: rows of
    (band, rep, component, hashes) of one bucket. A pair counts in the first band that it shares."""
    if not lone.num_rows or not crowd.num_rows:
        return pa.table({"p": pa.array([], pa.int64()), "q": pa.array([], pa.int64())})
    bounds = np.array([least_matches(n) for n in range(STEP, BANDS * ROWS + 1, STEP)])
    sets = [[np.frombuffer(b, np.uint64) for b in t.column("hashes").to_pylist()] for t in (lone, crowd)]
    sigs = [np.array([signature(x) for x in each]) for each in sets]
    ids, parts = crowd.column("rep").to_numpy(), crowd.column("component").to_numpy()
    sizes = np.array([len(x) for x in sets[1]])
    out = []
    for x, own, part, band, sig in zip(sets[0], lone.column("rep").to_pylist(), lone.column("component").to_pylist(), lone.column("band").to_pylist(), sigs[0], strict=True):
        same = sigs[1] == sig
        first = same.reshape(len(same), BANDS, ROWS).all(axis=2).argmax(axis=1)
        matched = np.cumsum(same.reshape(len(same), -1, STEP).sum(axis=2), axis=1)
        at = np.flatnonzero((parts != part) & (first == band) & (matched >= bounds).all(axis=1))
        if not len(at):
            continue
        flat = np.concatenate([sets[1][i] for i in at])
        hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
        common = np.add.reduceat(hit, np.cumsum(sizes[at]) - sizes[at])
        good = at[100 * common >= THRESHOLD * (len(x) + sizes[at] - common)]
        for i in good[np.unique(parts[good], return_index=True)[1]]:
            out.append((int(ids[i]), own))
    return pa.table({"p": pa.array([p for p, _ in out], pa.int64()), "q": pa.array([q for _, q in out], pa.int64())})


def prefixes(sets: DataFrame) -> DataFrame:
    """(rep, size, token): of each set (rep, hashes), a written table, the PREFIX rarest hashes. Two sets at the threshold share one.

    The order is the same for all sets: hashes in many sets come last, by the number of these, the others first. Which are in many
    is counted over all sets; at most BROADCAST_ROWS of them are told to all tasks.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                found, n = np.unique(np.frombuffer(b"".join(batch.column(0).slice(start, 500).to_pylist()), np.int64), return_counts=True)
                yield pa.record_batch([pa.array(found), pa.array(n)], names=["token", "n"])

    counts = sets.select("hashes").mapInArrow(hashes, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > CROWD)
    counts = materialize(counts, "dup-common")
    most = counts.count()
    if most > BROADCAST_ROWS:
        counts = counts.where(F.col("n") > counts.approxQuantile("n", [1 - BROADCAST_ROWS / most / 2], 1e-4)[0])
    common = counts.select("token", "n").toArrow().sort_by("token")
    sent = sets.sparkSession.sparkContext.broadcast((common.column("token").to_numpy(), common.column("n").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, n = sent.value
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                chosen = []
                for raw in part.column(1).to_pylist():
                    h = np.frombuffer(raw, np.int64)
                    rank = np.zeros(len(h), np.int64)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                        rank = np.where(tokens[at] == h, n[at], 0)
                    chosen.append(h[np.lexsort((h, rank))[: len(h) - -(-THRESHOLD * len(h) // 100) + 1]])
                sizes = pa.array(np.array([len(raw) // 8 for raw in part.column(1).to_pylist()], np.int64))
                owner = pa.array(np.repeat(np.arange(len(chosen)), [len(c) for c in chosen]))
                yield pa.record_batch([part.column(0).take(owner), sizes.take(owner), pa.array(np.concatenate(chosen))], names=["rep", "size", "token"])

    return sets.select("rep", "hashes").mapInArrow(run, "rep long, size long, token long")


def last_links(placed: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Links between different components of a bucket; placed: a written table of (key, band, rep, component).

    A pair at the threshold shares a rare hash (prefixes()). Members that share one which at most CROWD of them have are paired: so
    many for each row at most, and hardly any where a bucket comes from a passage that unlike texts share. The others, nearly all of
    whose shingles are in many texts, are compared block by block in their buckets (crossing()).
    """
    texts = texts_of(placed.select(F.col("rep").alias("id")).distinct(), docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_parts(batches, 1, SLICE_CHARS):
            yield pa.record_batch([part.column(0), pa.array([h.tobytes() for h in shingle_hashes(texts, k)], pa.binary())], names=["rep", "hashes"])

    sets = materialize(texts.mapInArrow(run, "rep long, hashes binary").dropDuplicates(["rep"]), "dup-sets")
    rare = materialize(prefixes(sets), "dup-prefixes")
    shared = materialize(rare.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dup-tokens")
    few = attach(rare, shared.where(F.col("n") <= CROWD), "token").join(placed.select("rep", "component").distinct(), "rep")
    p, q = few.alias("p"), few.alias("q")
    like = F.least("p.size", "q.size") * 100 >= F.greatest("p.size", "q.size") * THRESHOLD
    pairs = p.join(q, F.expr("p.token = q.token and p.rep < q.rep and p.component <> q.component") & like)
    pairs = materialize(pairs.select(F.col("p.rep").alias("p"), F.col("q.rep").alias("q")).distinct(), "dup-pairs")
    new = links(pairs, pairs.count(), reps, docs, k)
    crowded = attach(rare, shared.where(F.col("n") > CROWD), "token").select("rep").distinct()
    left = materialize(placed.join(crowded, "rep", "left_semi"), "dup-crowded")
    if left.isEmpty():
        return new
    weighed = left.join(sets.select("rep", (F.octet_length("hashes") / 8).alias("weight")), "rep")
    parts = weighed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    blocks = lambda w: F.ceil(w / BLOCK_SHINGLES).cast("int")
    most = F.max(F.struct("n", "component", "w"))
    buckets = parts.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), blocks(F.sum("w")).alias("blocks"), F.greatest(blocks(F.sum("w") - most["w"]), F.lit(1)).alias("lone_blocks"), most["component"].alias("largest"))
    rows = attach(left, materialize(buckets.where("parts > 1").drop("parts"), "dup-blocks"), "key")
    block = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    crowd = rows.select("key", "band", "rep", "component", block(F.col("blocks"), 1).alias("i"), every(F.col("lone_blocks")).alias("j"))
    lone = rows.where("component <> largest").select("key", "band", "rep", "component", block(F.col("lone_blocks"), 2).alias("j"), every(F.col("blocks")).alias("i"))
    columns = ["key", "i", "j", "band", "rep", "component", "hashes"]
    grouped = lambda df: df.join(sets, "rep").select(columns).toDF(*columns).groupBy("key", "i", "j")
    close = grouped(lone).cogroup(grouped(crowd)).applyInArrow(crossing, "p long, q long")
    return new.unionAll(confirm(materialize(close.distinct(), "dup-close"), docs, k))


def classes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, rep, sig), a row for each document; rep is null for empty sets and null ids, sig is kept for
    representatives alone."""
    signed = materialize(signatures(docs, k), "dup-signatures")
    again = signed.where("set_hash is not null").groupBy("set_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    own = attach(signed, materialize(again, "dup-copies"), "set_hash", "left")
    rep = F.when(F.col("doc_id").isNotNull() & F.col("set_hash").isNotNull(), F.coalesce("least", "doc_id"))
    own = own.select("doc_id", "n_shingles", rep.alias("rep"), "sig")
    return materialize(own.withColumn("sig", F.when(F.col("doc_id") == F.col("rep"), F.col("sig"))), "dup-classes")


def linked(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """classes(), and (node, component) of the representatives that are linked to others."""
    own = classes(docs, k)
    reps = own.where("sig is not null").select("rep", "sig")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    rows = reps.select(F.posexplode(keys).alias("band", "key"), "rep")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n"))
    members = materialize(attach(rows, materialize(shared, "dup-keys"), "key"), "dup-buckets")
    total = members.count()
    parts = empty(members.sparkSession, "node long, component long")
    found, done = None, None  # links and pairs so far
    for turn in range(PIVOT_ROUNDS + 1):
        placed = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        if turn:
            placed = materialize(placed.where("size > 2"), "dup-placed", total)
            apart = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
            placed = attach(placed, materialize(apart.select("key", "n"), "dup-apart"), "key").select("key", "band", "rep", "component")
            placed = materialize(placed, "dup-left", total)
            if placed.isEmpty():
                break
        if turn == PIVOT_ROUNDS:
            new = last_links(placed, reps, docs, k)
        else:
            order = F.xxhash64("rep", "key", F.lit(turn)) if turn else F.col("rep")
            pivots = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("rep", "component"), order).alias("pivot"))
            pairs = attach(placed, materialize(pivots, "dup-pivots", total), "key").where("component <> pivot.component")
            pairs = pairs.select(F.col("pivot.rep").alias("p"), F.col("rep").alias("q"))
            pairs = pairs.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.min("p").alias("p"))
            if done is not None:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            pairs = materialize(pairs.select("p", F.when(F.col("p") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("q")), "dup-pairs", total)
            number = pairs.count()
            if not number:
                continue
            done = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
            new = links(pairs, number, reps, docs, k)
        new = materialize(new, "dup-links")
        found = new if found is None else found.unionAll(new)
        if not new.isEmpty():
            parts = components(found)
    return own, parts


def near_duplicates(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each document."""
    own, parts = linked(docs, shingle_words)
    rows = own.drop("sig").join(parts, F.col("rep") == F.col("node"), "left")
    part = F.coalesce("component", "rep", "doc_id")
    return rows.select("doc_id", "n_shingles", part.alias("component_id"), F.coalesce(part == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """The rows of docs but for those that another document of their group stands for."""
    gone = materialize(near_duplicates(docs, shingle_words).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct(), "dup-gone")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["gone_id"], "left_anti")
