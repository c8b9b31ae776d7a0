"""Ops 2, 3 and 8."""

import random

import numpy as np
import pytest
from brute import pii_base, quality
from pyspark.sql import functions as F

from oakgraph.llm import language, pii
from oakgraph.llm import quality as Q


@pytest.mark.parametrize("packed", [Q.PACKED, 0])
def test_longest_repeats_equal_brute_force(monkeypatch, packed):
    monkeypatch.setattr(Q, "PACKED", packed)
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 50))]
        n = len(s)
        want = []
        for i in range(n):
            best = 0
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and s[i + k] == s[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best if best >= Q.SEED else 0)
        assert Q.longest_repeats(np.array(s, np.int64)).tolist() == want


def check_quality(df):
    for r in Q.measure(df.select("doc_id", "text"), into="q").collect():
        want = quality(r["text"])
        q = r["q"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["covered_words"]) == want[:6]
        if want[6] is not None:
            assert q["longest_repeat"] == want[6]


def test_quality(documents, odd, no_documents):
    check_quality(documents.where("n_chars < 6000"))
    check_quality(odd.where("doc_id is null or doc_id <> 4"))
    assert Q.verdicts(no_documents).count() == 0
    long = Q.verdicts(odd).where("doc_id = 4").first()
    assert (long["n_words"], long["base_failed"], long["kept"]) == (30_001, True, False)
    assert Q.verdicts(odd).count() == odd.count()
    assert Q.keep_good(odd).columns == odd.columns


def test_quality_rejects_repeats_the_base_rule_lets_pass(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"w{rng.random()}" for _ in range(n))
    part = fresh(40)
    df = spark.createDataFrame([(1, f"{part} {fresh(20)} {part} {fresh(120)}"), (2, fresh(200))], "doc_id long, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in Q.verdicts(df).collect()}
    assert got == {1: (False, False), 2: (False, True)}


def check_pii(df):
    texts = {(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}
    want = sorted((str(i), *pii_base(t)[0], pii_base(t)[1]) for i, t in texts)
    assert sorted({(str(r[0]), *r[1:6]) for r in pii.report(df).collect()}) == want


def test_pii_base(spark, documents, odd, no_documents):
    rng = random.Random(4)
    noise = ["".join(rng.choices("aé1.@+-_% 25()\n7.0", k=rng.randint(0, 80))) for _ in range(1500)] + ["".join(rng.choices("1234567890- ", k=rng.randint(0, 60))) for _ in range(500)]
    check_pii(spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string"))
    check_pii(documents)
    check_pii(odd)
    assert pii.report(no_documents).count() == 0
    assert pii.sanitise(odd).columns == odd.columns
    assert pii.sanitise(odd).where("doc_id = 2 and text is null").count() == 1
    assert pii.sanitise(odd).where("pii_spans <> 'kept'").count() == 0


def test_terms_that_disclose_are_found_everywhere(spark):
    rng = random.Random(6)
    common = [f"word{i}" for i in range(60)]
    filler = lambda: " ".join(rng.choices(common, k=30))
    rows = [f"{filler()} Zorblax wrote zed@corp.com again {filler()}" for _ in range(6)] + [filler() for _ in range(60)] + [f"about zorblax, then {filler()}"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    terms = {r["term"] for r in pii.disclosing_terms(df).collect()}
    assert {"zorblax", "wrote", "again"} == terms
    spans = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert spans[66] == "term:6:13" and spans[30] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "orblax" not in clean[66] and clean[30] == rows[30] and "[EMAIL]" in clean[0]


def test_copies_have_one_context(spark):
    text = "some rare words qwxz vbnm stand near zed@corp.com in every copy of it"
    df = spark.createDataFrame([(i, text) for i in range(50)] + [(i, f"other text {i}") for i in range(50, 90)], "doc_id long, text string")
    assert pii.disclosing_terms(df).count() == 0


def test_sanitised_overlaps(spark):
    df = spark.createDataFrame([(1, "call +1 (017) 555-7713 or x@y.org."), (2, "no data")], "doc_id long, text string")
    assert [r["text"] for r in pii.sanitise(df).orderBy("doc_id").collect()] == ["call [PHONE] or [EMAIL].", "no data"]


def test_very_many_matches_in_one_text(spark):
    """Blocks of spans put together: equal to brute force, and in time about proportional to their number."""
    import time

    def seconds(n):
        text = "Ünder " + " ".join(f"u{i}@ex.org x{i}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        r = pii.report(df).first()
        clean = pii.sanitise(df).first()["text"]
        took = time.perf_counter() - start
        assert clean == "Ünder " + " ".join(f"[EMAIL] x{i}" for i in range(n))
        want = pii_base(text)
        assert ([r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]], r["base_sha256"]) == want
        return took

    seconds(300)
    few, many = seconds(1000), seconds(8000)
    assert many < 8 * few + 10


def test_terms_hidden_by_base_spans(spark):
    rng = random.Random(12)
    for _ in range(5):
        spans = sorted((s, rng.choice([0, 1, 2, 3, 4, 4, 4]), s + rng.randint(1, 9)) for s in rng.sample(range(4000), 700))
        want = [s for s in spans if s[1] < 4 or not any(b[1] < 4 and b[0] < s[2] and s[0] < b[2] for b in spans)]
        df = spark.createDataFrame([(spans,)], "spans array<struct<start:int,kind:int,end:int>>")
        assert [tuple(s) for s in df.select(pii.visible(F.col("spans")).alias("v")).first()["v"]] == want


@pytest.fixture(scope="module")
def model(documents):
    return language.fit(documents)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.cross_checked(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_words_of_switched_text_are_told_apart(documents, model):
    take = lambda lang: documents.where((F.col("lang") == lang) & (F.col("n_chars") > 800)).orderBy("doc_id").first()["text"].split()[5:45]
    words = take("en") + take("fr") + take("en")
    f = language.features(words)
    gamma, _ = language.forward_backward(language.emissions(f, len(words), model), np.array([len(words)]), model.moves, model.start)
    named = [model.langs[i] for i in gamma.argmax(axis=1)]
    assert np.mean(np.array(named) == ["en"] * 40 + ["fr"] * 40 + ["en"] * 40) > 0.9


def by_hand(word, model):
    """Emission of a word, n-gram by n-gram."""
    low = lambda c: (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else ""
    padded = ["", *map(low, word), ""]
    out = np.zeros(len(model.langs))
    for n in range(1, language.NGRAM + 1):
        for i in range(len(padded) - n + 1):
            part = padded[i : i + n]
            if not any(part) or not all(part if n == 1 else part[1:-1]):
                continue
            h = n
            for c in part:
                h = ((h ^ (ord(c) if c else 0)) * 0x9E3779B97F4A7C15) % 2**64
                h ^= h >> 32
            out += model.weights[(h >> (64 - language.BITS)) % len(model.weights)]
    for run in "".join(c or " " for c in map(low, word)).split():
        h = sum(ord(c) * pow(0x100000001B3, j + 1, 2**64) for j, c in enumerate(run)) % 2**64
        at = np.flatnonzero(model.lexicon == np.uint64(h))
        if len(at):
            out += model.trust * model.odds[at[0]]
    return out


def test_predictions_equal_brute_force(spark, documents, model):
    """Features and emissions by hand, posteriors by plain recursions over one text at a time."""
    texts = [" ".join((r["text"] or "").split()[:60]) for r in documents.limit(12).collect()] + ["don't l'été 42 x-ray", "7 8", "Straße a1b2 \u0130x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(df, model).collect()}
    for i, text in enumerate(texts):
        emit = [by_hand(w, model) for w in text.split() if any(map(str.isalpha, w))]
        if not emit:
            assert got[i] == ("und", 0.0)
            continue
        move, alphas, beta, post = np.exp(model.moves), [], np.ones(len(model.langs)), []
        for e in emit:
            a = np.exp(e - e.max()) * (np.exp(model.start) if not alphas else alphas[-1] @ move)
            alphas.append(a / a.sum())
        for e, a in zip(emit[::-1], alphas[::-1], strict=True):
            post.append(a * beta / (a * beta).sum())
            beta = move @ (np.exp(e - e.max()) * beta)
            beta /= beta.sum()
        mean = np.mean(post, axis=0)
        assert got[i][0] == model.langs[int(mean.argmax())] and abs(got[i][1] - mean.max()) < 1e-4


def test_small_languages_keep_their_words(spark):
    """A language with very many words takes no place in the lexicon from another."""
    rows = [(i, " ".join(f"{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}" for j in range(i * 30, i * 30 + 30)), "big") for i in range(80)] + [(1000 + i, "zzzz yyyy", "small") for i in range(3)] + [(None, "nowhere", "small")]
    found = {r["word"]: {b["lang"]: b["n"] for b in r["by"]} for r in language.lexicon_table(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found["zzzz"] == {"small": 3} and len(found) == 2403
    assert language.sampled(spark.createDataFrame(rows * 2 + [(1000, "aaaa", "small")], "doc_id long, text string, lang string")).where("lang = 'small'").count() == 3


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    sizes, moves, start = np.array([3, 1, 4, 0]), rng.normal(size=(2, 2)), rng.normal(size=2)
    emit = rng.normal(size=(8, 2))
    gamma, pairs = language.forward_backward(emit, sizes, moves, start)
    at, expected = 0, np.zeros((2, 2))
    for n in sizes:
        total, marginal, seen = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for path in itertools.product(range(2), repeat=int(n)):
            if not n:
                continue
            w = np.exp(start[path[0]] + sum(emit[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for t, y in enumerate(path):
                marginal[t, y] += w
            for a, b in itertools.pairwise(path):
                seen[a, b] += w
        if n:
            np.testing.assert_allclose(gamma[at : at + n], marginal / total, rtol=1e-9)
            expected += seen / total
        at += n
    np.testing.assert_allclose(pairs, expected, rtol=1e-9)


def test_language_odd_rows(odd, no_documents, model):
    got = {(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in language.predict(odd, model).collect()}
    assert {(2, "und", False), (3, "und", False), (5, "und", False)} <= got
    assert all(lang in model.langs for i, lang, _ in got if i in (1, 4, 6, 8))
    assert language.cross_checked(odd).count() == odd.count()
    assert language.cross_checked(no_documents).count() == 0
    assert language.predict(odd, None).where("lang_pred <> 'und'").count() == 0
