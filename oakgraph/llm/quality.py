"""Quality rules: word statistics and repetition found with suffix arrays.

The words of each text are sorted by suffix (prefix doubling on groups that are still equal); the longest
common prefixes of neighbours give the intervals of maximal repeated substrings. Their spans are united, and
a text is rejected where the united spans cover too much of it or one repeat is too long for it.

A slice of texts is sorted at once: a symbol is a word of one text, so no repeat spans two texts.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows each give a row;
ties do not arise, since every text is judged by itself; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, row_slices, unused

SEED = 3  # words of the shortest repeat
MIN_WORDS = 50
MAX_REPEAT_WORDS = 50  # per cent of words in repeated 3-word windows
LONG = 10  # words from which a repeat counts for the suffix-array rule
MAX_COVERED = 30  # per cent of words that such repeats cover
MAX_LONGEST = 30  # per cent of words that the longest repeat has
SYMBOLS = "#*$%&|<>"
PACKED = (1 << 21) - 1  # symbols below this fit three to a 64-bit key


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position: length of the longest substring from there that is found elsewhere too; 0 if under SEED.

    symbols: non-negative integers.
    """
    n = len(symbols)
    longest = np.zeros(n, np.int64)
    if n <= SEED:
        return longest
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(SEED, np.int64)])
    if symbols.max() < PACKED:
        keys = [padded[:n] << 42 | padded[1 : n + 1] << 21 | padded[2 : n + 2]]
        sa = np.argsort(keys[0], kind="stable")
    else:
        keys = [padded[j : j + n] for j in range(SEED)]
        sa = np.lexsort(keys[::-1])
    fresh = np.concatenate([[True], np.any([k[sa][1:] != k[sa][:-1] for k in keys], axis=0)])
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # of each place in sa: where its group starts
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = group, -1
    levels, h = [(SEED, rank.astype(np.int32))], SEED
    shared = ~fresh
    shared[:-1] |= ~fresh[1:]
    places = live = np.flatnonzero(shared)
    while len(live):
        follow = rank[np.minimum(sa[live] + h, n)]
        order = np.lexsort((follow, group[live]))
        sa[live], follow = sa[live][order], follow[order]
        starts = np.concatenate([[True], (group[live][1:] != group[live][:-1]) | (follow[1:] != follow[:-1])])
        group[live] = live[np.maximum.accumulate(np.where(starts, np.arange(len(live)), 0))]
        rank[sa[live]] = group[live]
        h *= 2
        alone = starts & np.concatenate([starts[1:], [True]])
        live = live[~alone]
        if len(live):
            levels.append((h, rank.astype(np.int32)))
    pair = places[1:][~fresh[places[1:]]]  # neighbours that share SEED words at least
    a, b = sa[pair - 1], sa[pair]
    lcp = np.zeros(len(pair), np.int64)
    for h, ranks in reversed(levels):
        same = ranks[np.minimum(a + lcp, n)] == ranks[np.minimum(b + lcp, n)]
        lcp += np.where(same & (np.maximum(a, b) + lcp < n), h, 0)
    for _ in range(SEED - 1):
        same = padded[np.minimum(a + lcp, n)] == padded[np.minimum(b + lcp, n)]
        lcp += same & (np.maximum(a, b) + lcp < n)
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions the repeats of ``least`` words or more cover."""
    at = np.arange(len(longest))
    return np.maximum.accumulate(np.where(longest >= least, at + longest, 0)) > at if len(at) else np.zeros(0, bool)


def spans(longest: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The united spans of repeats of ``least`` words or more: (first word, end)."""
    edge = np.diff(np.concatenate([[0], covered(longest, least).astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
MEASURES = T.StructType([*(T.StructField(n, T.LongType()) for n in FIGURES), T.StructField("repeat_spans", T.ArrayType(SPAN))])


def figures(texts: list[str]) -> pa.StructArray:
    """MEASURES of each text."""
    counts, symbols, base, chars, marks, lines = [], [], 0, [], [], []
    for text in texts:
        words, seen = WORD.findall(text), {}
        symbols += [seen.setdefault(w, base + len(seen)) for w in words]
        base += len(seen)
        counts.append(len(words))
        chars.append(sum(map(len, words)))
        marks.append(sum(map(text.count, SYMBOLS)))
        kept = [x for x in text.split("\n") if WORD.search(x)]
        lines.append(len(kept) - len(set(kept)))
    longest = longest_repeats(np.array(symbols, np.int64))
    ends = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
    each = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    most = [int(longest[a:b].max(initial=0)) for a, b in each]
    found = [[{"start": s, "end": e} for s, e in spans(longest[a:b], LONG)] if m >= LONG else [] for (a, b), m in zip(each, most, strict=True)]
    columns = [pa.array(x, pa.int64()) for x in (counts, chars, marks, lines, total(covered(longest, SEED)), total(covered(longest, LONG)), most)]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.StructArray.from_arrays([*columns, pa.array(found, span)], names=MEASURES.names)


def measure(df: DataFrame, text_col: str = "text", into: str = "quality") -> DataFrame:
    """All columns of df and ``into``, a struct of the MEASURES of each whole text; no shuffle.

    repeat_spans has the united spans of repeats of LONG words or more: first word and end.
    """
    if into in df.columns:
        raise ValueError(f"the input has a column named {into} already; choose another name")
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in row_slices(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, figures(texts)], names=[*part.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, MEASURES)]))


def base_failed(q: str) -> Column:
    """The base rule on the struct column q."""
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT_WORDS * F.col(f"{q}.n_words"))


def passes(q: str) -> Column:
    """The base rule and the limits on long repeats."""
    n = F.col(f"{q}.n_words")
    return ~base_failed(q) & (100 * F.col(f"{q}.covered_words") <= MAX_COVERED * n) & (100 * F.col(f"{q}.longest_repeat") <= MAX_LONGEST * n)


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the base figures, base_failed and kept."""
    q = unused("quality", df.select(id_col, text_col))
    base = [F.col(f"{q}.{n}") for n in FIGURES[:5]]
    return measure(df.select(id_col, text_col), text_col, q).select(id_col, *base, base_failed(q).alias("base_failed"), passes(q).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, unchanged; no shuffle."""
    q = unused("quality", docs)
    return measure(docs, text_col, q).where(passes(q)).select(docs.columns)
