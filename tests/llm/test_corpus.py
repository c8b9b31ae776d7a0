"""Ops 1, 5, 6, 7 and 9, and connected components."""

import base64
import hashlib
import random

import numpy as np
import pytest
from brute import WORD, components, mix_targets, nearest
from pyspark.sql import functions as F

from oakgraph.llm import ann, chunks, mixing, near_dups, warc
from oakgraph.llm.components import components as connected


# Nearest neighbours


def search(df, k=10):
    index = ann.build_index(df)
    return ann.search(index, index.rows.where("id % 100 = 0"), k)


def test_neighbours_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = nearest([(r["vec_id"], r["embedding"]) for r in df.collect()], 10)
    got = {}
    for r in search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    for q in got:
        assert got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "x"), (0, [1.0, 2.0], "x"), (1, [1.0, 2.0], None), (2, [1.0, 2.0], ""), (3, None, ""), (4, [0.0, 0.0], ""), (5, [1.0, None], ""), (6, [nan, 1.0], ""), (7, [inf, 1.0], ""), (8, [], ""), (9, [1.0], ""), (100, [4.0, 6.0], ""), (None, [1.0, 2.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string").repartition(3)
    got = [tuple(r) for r in search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 5.0), (100, 1, 0, 5.0), (100, 2, 1, 5.0), (100, 3, 2, 5.0)]
    assert search(df.limit(0)).count() == 0


def test_neighbours_of_large_vectors(spark):
    """An outlier that moves the centre, and norms whose squares are no float32."""
    rows = [(0, [1e30, 0.0]), (1, [1e20, 2e20]), (2, [1e20, 3e20]), (3, [9e20, 2e20]), (100, [1e20, 2.5e20])]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    assert [i for q, _, i in got if q == 100] == [1, 2, 3, 0] and len(got) == 8


def test_tiles_and_blocks(spark, monkeypatch, tmp_path):
    """Several tiles, blocks and query steps, with ties, and an index read again from its folder."""
    rng = random.Random(7)
    rows = [(i, [float(rng.randrange(6)) for _ in range(5)]) for i in range(1500)] + [(1500 + i, [rng.gauss(0, 1) for _ in range(70)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(ann, "TILE_BYTES", 2000)
    monkeypatch.setattr(ann, "FIRST_ROWS", 60)
    index = ann.build_index(df, path=f"file://{tmp_path}/index")
    want, got = nearest(rows, 10), {}
    for r in ann.search(index, index.rows.where("id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in got)
    assert sum([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want) >= 21  # of 22
    monkeypatch.setattr(ann, "BLOCK", 64)
    rows = [(b, v) for b, v in rows if len(v) == 70]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    turned = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ ann.rotation(70)
    best = ann.Best(ann.Tile(ids[:40], x[:40], np.full(40, np.inf), np.zeros(70)), 10)
    for s in range(0, 700, 64):
        part = slice(s, s + 64)
        best.search_block(ids[part], x[part], np.packbits(turned[part] > 0, axis=1), np.linalg.norm(x[part], axis=1), np.abs(turned[part]).sum(axis=1) / np.sqrt(turned.shape[1]))
    hits = 0
    for n, q in enumerate(ids[:40]):
        d = np.sqrt(((x - x[n]) ** 2).sum(axis=1))
        hits += len({*ids[np.argsort(np.where(ids == q, np.inf, d))[:10]]} & {*best.i[best.q == n]})
    assert hits >= 396 and (np.diff(best.q) >= 0).all() and best.reranked < 40 * 700


def test_estimates_come_from_packed_bits():
    """The sums of common bits are the inner products of rounded queries and signs."""
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(20, 37)), rng.normal(size=(50, 37))
    tile = ann.Tile(np.arange(20), q, np.full(20, np.inf), np.zeros(37))
    signs = x @ ann.rotation(37) > 0
    got = tile.estimate(slice(0, 20), ann.words_of(signs.astype(np.uint8)))
    turned = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ ann.rotation(37)
    low, step = turned.min(axis=1, keepdims=True), (turned.max(axis=1, keepdims=True) - turned.min(axis=1, keepdims=True)) / 15
    want = (low + step * np.rint((turned - low) / step)) @ np.where(signs, 1, -1).T / np.sqrt(signs.shape[1])
    np.testing.assert_allclose(got, want, atol=2e-5)
    assert (np.abs(got - turned @ np.where(signs, 1, -1).T / np.sqrt(signs.shape[1])) > tile.lost[:, None]).mean() < 0.01


def test_bounds_hold(spark):
    """The estimate's error bound fails for few pairs only."""

    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(50, 64))
    turn = ann.rotation(64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = unit @ turn
    fit = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])
    ours = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ turn
    estimate = ours @ (np.where(turned > 0, 1, -1) / np.sqrt(turn.shape[1])).T / fit
    width = ann.ERROR_SCALE * np.sqrt(1 - fit**2) / fit / np.sqrt(turn.shape[1] - 1)
    assert (np.abs(estimate - ours @ turned.T) > width).mean() < 0.005


# Mixing


def check_mix(df):
    rows = mixing.plan(df).collect()
    words = lambda t: len(WORD.findall(t or ""))
    docs = df.select("doc_id", "text", "source").collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(d["doc_id"]), words(d["text"])) for d in docs)
    sizes = {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + words(d["text"])
    want = mix_targets(sizes)
    named = {d["doc_id"]: d["source"] for d in docs}
    taken, most = {}, {}
    for r in rows:
        s = named[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s], most[s] = taken.get(s, 0) + r["taken"], max(most.get(s, 0), r["size"])
    for s in taken:
        assert abs(taken[s] - want[s]) <= most[s]
        for r in rows:  # complete epochs first
            if named[r["doc_id"]] == s and r["size"] and sizes[s]:
                assert r["taken"] // r["size"] - int(want[s] // sizes[s] + 1e-9) in (0, 1)
    return sorted(map(tuple, rows), key=str)


def test_mix(documents, odd, no_documents, monkeypatch):
    first = check_mix(documents)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert check_mix(documents.repartition(5)) == first
    check_mix(odd.where("doc_id is null or doc_id <> 1"))
    assert mixing.plan(odd).count() == odd.count()
    assert mixing.plan(no_documents).count() == 0


def test_mix_repeats_rows(documents, odd):
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.plan(documents).where("size > 0").collect()}
    got = {r["doc_id"]: r["count"] for r in mixing.mix(documents).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mix(odd).columns == odd.columns


def test_weights_decide_who_is_taken(spark):
    rows = [(i, ("###" if i % 2 else "aaa") + " b" * 9, "s") for i in range(2000)] + [(10**6 + i, "c " * 40, "t") for i in range(500)] + [(2 * 10**6 + i, "d " * 40, "u") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goal = {r["source"]: r for r in mixing.targets(spark.createDataFrame([("a", 100), ("b", 100), ("c", 800), (None, 100)], "source string, source_size long")).collect()}
    assert {k: r["target"] for k, r in goal.items()} == {k: pytest.approx(v) for k, v in mix_targets({"a": 100, "b": 100, "c": 800, None: 100}).items()}
    taken = mixing.plan(df).where("doc_id < 2000").withColumn("extra", F.col("taken") / F.col("size") % 1 + F.floor(F.col("taken") / F.col("size")))
    mean = {r["odd"]: r["m"] for r in taken.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("extra").alias("m")).collect()}
    assert mean[0] > mean[1]


def test_any_weights_give_even_buckets_and_one_mix(spark, monkeypatch):
    """Few buckets or many, the same documents are taken, and no bucket holds many of a source whose weights differ by much."""
    rows = [(i, "w " * (1 + i % 7), "s" if i % 5 else "t", [1.0, 0.05, 0.001, 40.0, None, 0.0, -1.0, float("nan"), float("inf")][i % 9 if i < 900 else i % 2]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, good double").repartition(3)
    first = None
    for size in (10_000, 100):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", size)
        got = sorted(map(tuple, mixing.plan(df, weight=F.col("good")).collect()))
        assert first in (None, got)
        first = got
    keys = df.select(*mixing.keyed(mixing.SEED, F.col("good"))).cache()
    cuts = mixing.cutoffs(keys)
    filled = keys.alias("r").join(cuts.alias("c"), F.expr("r.source <=> c.source")).groupBy("r.source", mixing.bucket_of(F.col("r.key"), F.col("c.buckets"), F.col("c.classes")).alias("b")).count().collect()
    assert len(filled) > 50 and max(r["count"] for r in filled) < 200
    taken = {r[0]: r[4] / r[1] for r in first}
    mean = lambda rest: sum(taken[i] for i in range(900, 6000) if i % 2 == rest and i % 5) / sum(1 for i in range(900, 6000) if i % 2 == rest and i % 5)
    assert mean(0) > mean(1)
    assert mixing.mix(df, weight=F.col("good")).columns == df.columns


# Near duplicates


def check_near(df, k):
    rows = near_dups.near_duplicates(df, k).collect()
    want = components([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], k)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    return rows


def test_near_duplicates(spark, odd, no_documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_near(docs, 2)
    check_near(docs, 5)
    rows = check_near(odd.where("doc_id is null or doc_id <> 4"), 2)
    assert {(r["doc_id"], r["n_shingles"]) for r in rows} >= {(2, 0), (3, 0), (5, 0), (9, 1), (1, 5)}
    assert near_dups.near_duplicates(odd, 2).where("doc_id = 4 and n_shingles = 2 and kept").count() == 1
    assert near_dups.near_duplicates(no_documents, 2).count() == 0
    assert near_dups.keep_one(odd, 2).columns == odd.columns
    assert near_dups.keep_one(odd, 2).where("doc_id = 6").count() == 0


@pytest.mark.parametrize("blocks", [250_000, 600])
def test_groups_with_members_that_are_linked_with_few(spark, monkeypatch, blocks):
    """Texts at all distances from a base, so that pivots leave many apart."""
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", blocks)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        text = list(base)
        for _ in range(rng.choice([0, 1, 4, 8, 9, 10, 11, 12, 14])):
            text[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i * 7 % 1009, " ".join(text)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2)


def test_unlike_texts_with_a_passage_in_common(spark, monkeypatch):
    """A bucket of thousands of members that are not linked makes hardly any pairs, and the links among them are found."""
    rng = random.Random(14)
    passage = " ".join(f"p{i}" for i in range(90))
    rows = [(i, passage + " " + " ".join(f"u{rng.random()}" for _ in range(60))) for i in range(2000)]
    rows += [(5000 + i, rows[7 * i][1] + f" more{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes, real = [], near_dups.links
    monkeypatch.setattr(near_dups, "links", lambda pairs, most, *more: sizes.append(most) or real(pairs, most, *more))
    monkeypatch.setattr(near_dups, "crossing", None)  # no block is compared
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(df, 2).collect()}
    assert got == {i: 7 * (i - 5000) if i >= 5000 else i for i, _ in rows}
    assert sum(sizes) < 40 * len(rows)


def test_hot_keys_are_attached_in_place(spark, monkeypatch):
    from oakgraph.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(common, "KEY_ROWS", 10)
    rows = spark.createDataFrame([(i % 4 if i < 400 else i, i) for i in range(500)] + [(None, -1)], "k long, v long")
    again = spark.createDataFrame([(k, 100, f"x{k}") for k in range(4)] + [(k, 1, f"x{k}") for k in range(400, 450)], "k long, n long, x string")
    for how in ("inner", "left"):
        got = sorted(map(str, common.attach(rows, again, "k", how).collect()))
        assert got == sorted(map(str, rows.join(again.drop("n"), "k", how).collect()))


def test_pruning_threshold_keeps_linked_pairs():
    assert near_dups.least_matches(32) < 26 and near_dups.least_matches(160) < 128
    assert near_dups.least_matches(160) > 60


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
    assert sorted(map(tuple, connected(spark.createDataFrame([(1, 2), (2, 1), (1, 2), (None, 3), (4, None), (5, 5)], "a long, b long")).collect())) == [(1, 1), (2, 1)]


# WARC


def check_warc(df):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in df.select("page_id", "html").collect()]
    first = {}
    for i, p in pages:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    counts = {p: sum(q == p for _, q in pages) for _, p in pages}
    want = []
    for i, p in pages:
        again = counts[p] > 1 and first.get(p) is not None and first[p] != i
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None))
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == sorted(want, key=str)


def test_warc(spark, monkeypatch):
    check_warc(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    rows = [(1, "http://a b/\n", "same", 1), (2, None, "same", 1), (2, None, "same", 1), (3, "http://x", None, 1), (4, "u", "", 1), (None, "u", "same", 1), (None, "u", "alone é", 1), (7, "http://x", "<p>" + "z" * 300_000, 1)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    check_warc(odd)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 400)
    monkeypatch.setattr(warc, "MAX_GAP", 0)
    check_warc(odd)
    assert warc.round_trip(odd.limit(0)).count() == 0


def test_selected_records_come_whole(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    index = warc.write(pages, f"file://{tmp_path}/w")
    got = warc.read(index.where("page_id in (3, 4, 40)"), f"file://{tmp_path}/w").collect()
    want = {r["page_id"]: r["html"] for r in pages.where("page_id in (3, 4, 40)").collect()}
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {i: t for i, t in want.items() if i in {r["page_id"] for r in got if r["record_type"] == "response"}}
    assert len(got) == 3


def test_reads_are_coalesced():
    groups = [[tuple(p.values()) for p in g] for g in warc.coalesced([{"offset": o, "length": n} for o, n in [(100, 10), (0, 50), (50, 50), (10**6, 5)]])]
    assert groups == [[(0, 50), (50, 50), (100, 10)], [(10**6, 5)]]


# Chunks


def test_chunks_cover_texts_and_never_cut_characters():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices("abc é€😀 \n", k=rng.randint(0, 900)))
        (raw, ends), = chunks.split([text])
        assert ends == sorted(set(ends)) and (ends[-1] == len(raw) if raw else not ends)
        start = 0
        for e in ends:
            raw[start:e].decode()
            assert e - start <= chunks.MAX_CHUNK + 3 and (e - start >= chunks.MIN_CHUNK or e == len(raw))
            start = e


def test_borders_resist_insertions():
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefgh ", k=4000))
    cut = lambda t: {raw[a:b] for raw, ends in chunks.split([t]) for a, b in zip([0, *ends], ends, strict=False)}
    a, b = cut(text), cut(text[:1000] + "inserted" + text[1000:])
    assert len(a & b) > 0.9 * len(a)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def test_shared_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(5)
    passage = words(rng, 60)
    rows = [(i, f"{words(rng, 40)} {passage} {words(rng, 40)}" if i % 4 == 0 else words(rng, 140)) for i in range(80)]
    rows += [(200, rows[1][1])]
    got = {r["doc_id"]: r for r in chunks.summary(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i in range(0, 80, 4):
        assert got[i]["repeat_bytes"] > 150 and (i == 0) == (got[i]["dup_bytes"] == 0)
        # the chunk before the first common border may be shared with a later document than the first
        assert got[i]["first_ids"][:1] == ([] if i == 0 else [0]) and all(f < i and f % 4 == 0 for f in got[i]["first_ids"])
    assert got[200]["dup_bytes"] == got[200]["n_bytes"] and got[200]["first_ids"] == [1] and got[1]["dup_bytes"] == 0
    assert all(got[i]["repeat_bytes"] == 0 for i in range(2, 80) if i % 4)


def cut_by_hand(raw):
    """Chunk ends by the definition, byte by byte."""
    n, gear, w, r = len(raw), [int(g) for g in chunks.GEAR], chunks.WINDOW, chunks.REACH
    if n < chunks.MIN_RUN:
        return [n] if n else []
    hashed = [sum((gear[raw[i - j] if i >= j else 0] << j) for j in range(w)) % 65536 for i in range(n)]
    wanted = [i + 1 for i in range(n) if hashed[i] < 65535 and hashed[i] == min(hashed[max(0, i - r) : i + r + 1])]
    ends, start = [], 0
    whole = lambda at: next((x for x in range(at, n) if not 0x80 <= raw[x] < 0xC0), n)
    for at in [*wanted, n]:
        while at - start > chunks.MAX_CHUNK:
            start = whole(start + chunks.MAX_CHUNK)
            ends.append(start)
        if at < n and at - start >= chunks.MIN_CHUNK:
            start = whole(at)
            ends.append(start)
    return [*ends, n] if start < n else ends


def test_borders_equal_brute_force(documents):
    rng = random.Random(13)
    texts = [r["text"] for r in documents.where("n_chars < 3000").limit(60).collect()] + ["", "é", "word " * 300, "a" * 900] + ["".join(rng.choices("abé😀 \n", k=rng.randint(0, 700))) for _ in range(60)]
    for (raw, ends), text in zip(chunks.split(texts), texts, strict=True):
        assert raw == text.encode() and ends == cut_by_hand(raw)


def test_summary_equals_brute_force(documents):
    rows = sorted((r["doc_id"], r["text"].encode()) for r in documents.where("n_chars < 9000").collect())
    where, table = {}, {}
    for i, raw in rows:
        ends = cut_by_hand(raw)
        table[i] = [(a, b, raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        for a, _, c in table[i]:
            where.setdefault(c, []).append((i, a))
    got = {r["doc_id"]: (r["repeat_bytes"], r["dup_bytes"], r["first_ids"]) for r in chunks.summary(documents.where("n_chars < 9000")).collect()}
    for i, parts in table.items():
        runs, last = [], -1
        for a, b, c in parts:
            if len(where[c]) > 1:
                if a != last:
                    runs.append([])
                runs[-1].append((a, b, c))
                last = b
        kept = [p for run in runs if sum(b - a for a, b, _ in run) >= chunks.MIN_RUN for p in run]
        dup = [p for p in kept if min(where[p[2]]) != (i, p[0])]
        assert got[i] == (sum(b - a for a, b, _ in kept), sum(b - a for a, b, _ in dup), sorted({min(where[c])[0] for _, _, c in dup}))


def test_random_passages_of_51_words_are_found():
    """Two texts with one passage in common share a run of whole chunks."""
    rng = random.Random(1)
    missed = 0
    for _ in range(1000):
        passage = words(rng, 51)
        sets = []
        for raw, ends in chunks.split([f"{words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(2)]):
            sets.append([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        common, run, best = set(sets[1]), 0, 0
        for c in sets[0]:
            run = run + len(c) if c in common else 0
            best = max(best, run)
        missed += best < chunks.MIN_RUN
    assert missed <= 10


def test_chunks_of_odd_rows(odd, no_documents, documents):
    got = chunks.summary(odd)
    assert got.count() == odd.count()
    assert {(r["doc_id"], r["n_bytes"], r["dup_bytes"]) for r in got.collect()} >= {(2, 0, 0), (3, 0, 0)}
    assert chunks.summary(no_documents).count() == 0
    cleaned = chunks.remove_repeats(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count() and cleaned.where("text is null").count() == 1
    gone = {r["doc_id"]: r["n_bytes"] - r["dup_bytes"] for r in chunks.summary(documents).collect()}
    assert {r["doc_id"]: r["n"] for r in chunks.remove_repeats(documents).select("doc_id", F.octet_length("text").alias("n")).collect()} == gone


def test_short_copies_are_found(spark):
    rows = [(3, "a short text"), (1, "a short text"), (2, "another one"), (4, "é"), (5, "é"), (6, ""), (7, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["repeat_bytes"], r["dup_bytes"], r["first_ids"], r["spans"]) for r in chunks.summary(df, short_copies=True).collect()}
    assert got == {1: (12, 0, [], ""), 3: (12, 12, [1], "0:12"), 4: (2, 0, [], ""), 5: (2, 2, [4], "0:2")} | {i: (0, 0, [], "") for i in (2, 6, 7, 8)}
    assert {r["doc_id"]: r["text"] for r in chunks.remove_repeats(df, short_copies=True).collect()} == dict(rows) | {3: "", 5: ""}
