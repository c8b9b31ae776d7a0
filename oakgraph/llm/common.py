"""Shared pieces of the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: White space of str.split() that WORD takes for a part of a word.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words(text: str) -> list[str]:
    """What WORD finds; str.split() is faster where it gives the same."""
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


#: Texts handed to one vectorised step at once, in characters.
SLICE_CHARS = 1_000_000


def text_parts(batches: Iterator[pa.RecordBatch], text_at: int, limit: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of batches that hold about ``limit`` characters of the text column, each with its texts (null: empty).

    A text is never cut, so a longer one is a part of its own.
    """
    for batch in batches:
        column = pc.fill_null(batch.column(text_at), "")
        held = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(column):
            base = held[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(held, base + limit, "right")))
            yield batch.slice(start, end - start), column.slice(start, end - start)
            start = end
        del batch, column
        pa.default_memory_pool().release_unused()


def strings(column: pa.Array) -> list[str]:
    """The same as to_pylist() of strings without nulls, ten times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


def word_arrays(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the word of each place by its number, and where the words of each text end."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    names, at = coded.dictionary, coded.indices.to_numpy()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    if (empty := pc.index(names, pa.scalar("", names.type)).as_py()) >= 0:  # beside white space at either end of a text
        full = at != empty
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        at = at[full]
    return names, at, ends


def word_codes(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The same with the words in Python."""
    names, at, ends = word_arrays(texts)
    return strings(names), at, ends


def row_slices(batches: Iterator[pa.RecordBatch], text_at: int, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The same with the texts in Python."""
    for part, texts in text_parts(batches, text_at, limit):
        yield part, texts.to_pylist()


def id_text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_CHARS) -> Iterator[tuple[pa.Array, list]]:
    """The same for batches of (id, text), with the ids for the batch."""
    for part, texts in row_slices(batches, 1, limit):
        yield part.column(0), texts


def unused(name: str, *frames) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Broadcast a table of keys up to so many rows (about 100 bytes each).
BROADCAST_ROWS = 200_000
#: Rows of a key that one task may get in any case.
KEY_ROWS = 1_000


def attach(rows: DataFrame, again: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with again, a written table of (keys, n, more): a row for each key, which n rows or so hold. n is left out.

    No task gets all rows of a hot key: few keys are broadcast; of many, those that hold more than KEY_ROWS rows and more than
    one in BROADCAST_ROWS of all are, of which there are fewer than BROADCAST_ROWS, and only the others are shuffled.
    """
    keys = [keys] if isinstance(keys, str) else keys
    found = again.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).first()
    if found["keys"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(again.drop("n")), keys, how)
    most = max(KEY_ROWS, found["rows"] // BROADCAST_ROWS)
    hot, rest = again.where(F.col("n") > most).drop("n"), again.where(F.col("n") <= most).drop("n")
    cool = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cool.join(rest, keys, how))


class Recent:
    """What was computed for recent strings: two generations, of which the older is dropped when the younger is full."""

    def __init__(self, compute: Callable[[list[str]], Iterable[bytes]], most: int):
        self.compute, self.most = compute, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def lookup(self, lists: list[list[str]]) -> Callable[[str], bytes]:
        """Getter that knows all strings of the lists."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        missing = set().union(*lists).difference(self.young)
        if self.old:
            known = [s for s in missing if s in self.old]
            self.young.update(zip(known, map(self.old.__getitem__, known), strict=True))
            missing.difference_update(known)
        fresh = list(missing)
        self.young.update(zip(fresh, self.compute(fresh), strict=True))
        return self.young.__getitem__
