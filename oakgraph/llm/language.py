"""Language ID of words in code-switched text with a linear-chain conditional random field.

Labels are languages, one for each word. Emissions come from affixes and character n-grams of 1 to NGRAM letters
(hashed to 2**BITS weights, fewer for very many languages) and from a lexicon: how often words occur in each
language, counted over all training documents; it has every word that makes up MIN_SHARE of a language's words, so that each
language has 1 / MIN_SHARE words at most and none crowds out another. Transitions are learned from sequences put together from
stretches of STRETCH words of documents in different languages, as code-switched text is. Weights maximise the likelihood of labels
(Adam). They are fitted on a bounded sample of SAMPLE documents a language, all words of which are learned from, each once in an epoch.
Forward-backward then gives each word of every whole text its distribution over languages; a document's language is
the one with the largest mean, which is its score.

Texts of a slice are worked on together, position by position, longest first; no rows are shuffled to predict.

Defined cases: a null text or one without letters gives `und` with score 0; documents with a null language or a null id are
predicted but not learned from; of rows that share id and language, one text (the least) stands for all in the sample; without any
training document all are `und`; more than MOST_LANGUAGES languages are refused; ties go to the language that comes first by code
point; a very long text is labelled whole, as a slice of its own; repeated rows each give a row; a null id counts as the empty string
in the split; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize
from .common import text_parts, word_codes, words

NGRAM = 4
BITS, MODEL_BYTES = 18, 64 << 20  # weights, and what they may take
MIN_SHARE = 1 / 50_000  # of a language's words, for a word of the lexicon
SAMPLE = 200  # documents a language
MOST_LANGUAGES = 500
STRETCH, STRETCHES = 12, 4  # words from one document, and such parts of a training sequence
EPOCHS, RATE, DECAY = 30, 0.05, 1e-4
SLICE_CHARS = 2_000_000
FOLDS = 5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower case, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class Features(NamedTuple):
    """Of some strings: hashed n-grams and their strings, whole runs of letters (hash) and their strings, and which have letters."""

    grams: np.ndarray
    gram_of: np.ndarray
    runs: np.ndarray
    run_of: np.ndarray
    lettered: np.ndarray


def features(names: list[str]) -> Features:
    text = " " + " ".join(names) + " "
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(raw == 32) - 1  # names hold no space
    c = _letters()[raw].astype(np.uint64)
    is_letter = c > 0
    grams, of = [], []
    for n in range(1, NGRAM + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = np.full(m, n, np.uint64)
        inner, some = np.ones(m, bool), np.zeros(m, bool)
        for j in range(n):
            h = (h ^ c[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            some |= is_letter[j : j + m]
            if 0 < j < n - 1 or n == 1:
                inner &= is_letter[j : j + m]
        at = np.flatnonzero(inner & some)
        grams.append((h[at] >> np.uint64(64 - BITS)).astype(np.int64))
        of.append(owner[at + (~is_letter[at] if n > 1 else 0)])  # the letter's string, where the first is a border
    starts = np.flatnonzero(is_letter & ~np.concatenate([[False], is_letter[:-1]]))
    lettered = np.zeros(len(names), bool)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Features(none, none, none.astype(np.uint64), none, lettered)
    at = np.flatnonzero(is_letter)
    first = np.searchsorted(at, starts)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    power = np.cumprod(np.full(int(place.max()) + 1, 0x100000001B3, np.uint64))
    runs = np.add.reduceat(c[at] * power[place], first)
    lettered[owner[starts]] = True
    return Features(np.concatenate(grams), np.concatenate(of), runs, owner[starts], lettered)


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # (2**bits, languages)
    lexicon: np.ndarray  # sorted hashes of words
    odds: np.ndarray  # (words, languages)
    trust: float  # in the lexicon
    moves: np.ndarray  # transitions
    start: np.ndarray


def known(runs: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs the lexicon has, and where."""
    if not len(lexicon):
        return np.zeros(len(runs), bool), np.zeros(len(runs), np.int64)
    at = np.minimum(np.searchsorted(lexicon, runs), len(lexicon) - 1)
    return lexicon[at] == runs, at


def lexicon_scores(f: Features, n: int, lexicon: np.ndarray, odds: np.ndarray) -> np.ndarray:
    out = np.zeros((n, odds.shape[1]))
    hit, at = known(f.runs, lexicon)
    np.add.at(out, f.run_of[hit], odds[at[hit]])
    return out


def emissions(f: Features, n: int, model: Model) -> np.ndarray:
    out, grams = model.trust * lexicon_scores(f, n, model.lexicon, model.odds), f.grams & (len(model.weights) - 1)
    for k in range(len(model.langs)):
        out[:, k] += np.bincount(f.gram_of, weights=model.weights[grams, k], minlength=n)
    return out


def forward_backward(emit: np.ndarray, sizes: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each word's label, and of the moves summed over all; emit: (words, labels) of sequences of these sizes in a row."""
    labels = emit.shape[1]
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    longest = int(sizes.max(initial=0))
    active = np.searchsorted(-sizes[order], -np.arange(longest), "left")  # sequences longer than t
    at = np.concatenate([[0], np.cumsum(active)])
    step = np.arange(len(emit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    where = at[step] + np.repeat(rank, sizes)
    p = np.empty_like(emit)
    p[where] = np.exp(emit - emit.max(axis=1, keepdims=True))
    move, back = np.exp(moves), np.exp(moves).T.copy()
    alpha = np.empty_like(p)
    held = None
    for t in range(longest):
        n, a = active[t], at[t]
        held = (np.exp(start) if held is None else held[:n] @ move) * p[a : a + n]
        held /= held.sum(axis=1, keepdims=True)
        alpha[a : a + n] = held
    pairs = np.zeros((labels, labels))
    gamma = np.empty_like(p)
    beta = np.zeros((0, labels))
    for t in range(longest - 1, -1, -1):
        n, a = active[t], at[t]
        now = np.ones((n, labels))
        if len(beta):
            m, b = active[t + 1], at[t + 1]
            ahead = p[b : b + m] * beta
            now[:m] = ahead @ back
            total = (alpha[a : a + m] * now[:m]).sum(axis=1, keepdims=True)
            pairs += (alpha[a : a + m] / total).T @ ahead
            now[:m] /= now[:m].sum(axis=1, keepdims=True)
        g = alpha[a : a + n] * now
        gamma[a : a + n] = g / g.sum(axis=1, keepdims=True)
        beta = now
    return gamma[where], pairs * move


def train(sample: list[tuple[str, str]], lexicon: np.ndarray, odds: np.ndarray, langs: list[str]) -> Model:
    """sample: (lang, text)."""
    rng = np.random.default_rng(11)
    number = {x: i for i, x in enumerate(langs)}
    stretches = []
    for lang, text in sample:
        w = [x for x in words(text) if any(map(str.isalpha, x))]
        stretches += [(number[lang], w[i : i + STRETCH]) for i in range(0, len(w), STRETCH)]
    order = rng.permutation(len(stretches)).tolist()
    flat = [x for i in order for x in stretches[i][1]]
    gold = [stretches[i][0] for i in order for _ in stretches[i][1]]
    sizes = [sum(len(stretches[i][1]) for i in order[at : at + STRETCHES]) for at in range(0, len(order), STRETCHES)]
    bits = min(BITS, int(np.log2(MODEL_BYTES / (4 * len(langs)))))
    names = sorted(set(flat))
    index = {x: i for i, x in enumerate(names)}
    at, y, sizes = np.array([index[x] for x in flat], np.int64), np.eye(len(langs))[gold], np.array(sizes, np.int64)
    f = features(names)
    grams = f.grams & ((1 << bits) - 1)
    lex = lexicon_scores(f, len(names), lexicon, odds)
    if not len(at):
        return Model(langs, np.zeros((1 << bits, len(langs)), np.float32), lexicon, odds, 1.0, np.zeros((len(langs),) * 2), np.zeros(len(langs)))
    firsts = np.cumsum(sizes) - sizes
    inner = np.setdiff1d(np.arange(len(at)), firsts)
    seen = y[inner - 1].T @ y[inner]
    x = {"w": np.zeros((1 << bits, len(langs))), "trust": np.array([1.0]), "moves": np.zeros((len(langs),) * 2), "start": np.zeros(len(langs))}
    m = {k: np.zeros_like(v) for k, v in x.items()}
    v = {k: np.zeros_like(z) for k, z in x.items()}
    for epoch in range(1, EPOCHS + 1):
        model = Model(langs, x["w"], lexicon, odds, float(x["trust"][0]), x["moves"], x["start"])
        emit = emissions(f, len(names), model)
        gamma, pairs = forward_backward(emit[at], sizes, x["moves"], x["start"])
        wrong = y - gamma
        by_name = np.stack([np.bincount(at, weights=wrong[:, k], minlength=len(names)) for k in range(len(langs))], 1)
        g = {
            "w": np.stack([np.bincount(grams, weights=by_name[f.gram_of, k], minlength=1 << bits) for k in range(len(langs))], 1) / len(at) - DECAY * x["w"],
            "trust": np.array([(by_name * lex).sum() / len(at)]),
            "moves": (seen - pairs) / len(at),
            "start": wrong[firsts].sum(axis=0) / len(at),
        }
        for k in x:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            x[k] = x[k] + RATE * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-8)
    return Model(langs, x["w"].astype(np.float32), lexicon, odds, float(x["trust"][0]), x["moves"], x["start"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def sampled(rows: DataFrame) -> DataFrame:
    """(lang, doc_id, text) of SAMPLE documents of each language: those with the smallest hashes of their ids.

    Ids are ranked among a few times as many as are wanted, which the counts of the languages let through; texts are read for the chosen.
    """
    ids = rows.where("doc_id is not null").select("doc_id", "lang")
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("held")).limit(MOST_LANGUAGES + 1)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    likely = ids.join(F.broadcast(counts), "lang").where(spread * F.col("held") <= 4 * SAMPLE)
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy(spread, "doc_id"))
    chosen = likely.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("doc_id", "lang").distinct()
    return rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))


def lexicon_table(rows: DataFrame) -> DataFrame:
    """(word, by): of each word that makes up MIN_SHARE of the words of a language, how often each language has it."""
    heard = rows.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counts = materialize(heard.groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n")), "language-words")
    least = counts.groupBy("lang").agg((F.sum("n") * F.lit(MIN_SHARE)).alias("least"))
    known = counts.join(F.broadcast(least), "lang").where("n >= least").select("word").distinct()
    return counts.join(known, "word", "left_semi").groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("by"))


def fit(docs: DataFrame) -> Model | None:
    """Learn from the rows of docs (doc_id, text, lang) whose text, lang and doc_id are not null; None if there are none.

    The driver gets SAMPLE texts a language, and 1 / MIN_SHARE words a language at most, with their counts. What tasks get is the
    lexicon (8 bytes and 8 for each language a word) and MODEL_BYTES of weights at most.
    """
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    texts = sampled(rows).toPandas().sort_values(["doc_id", "lang"], kind="stable")
    langs = sorted(texts["lang"].unique())
    if not langs:
        return None
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages are more than the {MOST_LANGUAGES} that one model is made for")
    names, number, counts = [], {x: i for i, x in enumerate(langs)}, []
    for r in lexicon_table(rows.where("doc_id is not null")).orderBy("word").toLocalIterator():
        names.append(r["word"])
        counts.append(np.zeros(len(langs)))
        for b in r["by"]:
            counts[-1][number[b["lang"]]] = b["n"]
    table = np.array(counts).reshape(len(names), len(langs))
    f = features(names)
    whole = np.bincount(f.run_of, minlength=len(names)) == 1
    hashes = np.zeros(len(names), np.uint64)
    hashes[f.run_of] = f.runs
    share = (table + 0.5) / (table.sum(axis=0) + 1)
    odds = np.log(share / share.mean(axis=1, keepdims=True)).clip(-4, 4)
    order = np.argsort(hashes[whole])
    return train(list(texts[["lang", "text"]].itertuples(index=False, name=None)), hashes[whole][order], odds[whole][order], langs)


def label(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts))
    names, at, ends = word_codes(texts)
    f = features(names)
    keep = f.lettered[at]
    counts = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])])
    gamma, _ = forward_backward(emissions(f, len(names), model)[at[keep]], counts, model.moves, model.start)
    total = np.diff(np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(gamma, axis=0)])[np.concatenate([[0], np.cumsum(counts)])], axis=0)
    mean = total / np.maximum(counts, 1)[:, None]
    best = mean.argmax(axis=1)
    return [model.langs[b] if n else "und" for b, n in zip(best, counts, strict=True)], np.where(counts > 0, mean.max(axis=1), 0.0).clip(0, 1)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), a row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_parts(batches, 1, SLICE_CHARS):
            langs, scores = label(texts, sent.value)
            yield pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def cross_checked(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents that are not held out, predicted for all."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
