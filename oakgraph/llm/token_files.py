"""Token ids in ORC files: written in document order, read stripe by stripe.

Texts are range-partitioned and sorted by document id, encoded where they lie, and written by Spark's ORC
writer: integer columns are run-length encoded (version 2), every stripe has row indexes with the smallest
and largest document id of each row group, and a Bloom filter on the document ids. A file is one range of
ids, so that readers prune files, stripes and row groups by metadata, and stripes are read in parallel.

Each row keeps its start within its file; a manifest with a row for each file gives what the files before
it hold, so that global positions need neither a sort nor a window over all rows on reading.

Defined cases: a null text is empty and holds the end id alone; rows with a null id come first; rows that share an id each keep
their own row, in the order of their texts; a very long text is encoded whole, as a slice of its own; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from .. import runtime
from .common import Recent, strings, text_parts, word_arrays

#: Distinct pieces of words in a generation of what a worker remembers.
CACHE_WORDS = 400_000
#: Characters encoded at once.
SLICE_CHARS = 6_000_000
#: Broadcast the manifest up to so many files (24 bytes each).
MANIFEST_ROWS = 200_000
#: Letters whose lower case is one letter whatever is around them, and marks that are no part of a contraction.
LETTERS = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7))
MARKS = ".,;:!?#$%&*|"
PLAIN = f"[{LETTERS}]+"
ORC = {"orc.stripe.size": str(64 << 20), "orc.row.index.stride": "2000", "orc.bloom.filter.fpp": "0.01", "compression": "snappy"}


class WordEncoder:
    """The library's ids of whole texts, put together from the ids of their words.

    The normaliser folds white space, the pre-tokeniser drops it, and no token spans it, so the ids of a text
    are those of its words in a row. ``split_safe`` must be False for vocabularies without that property.
    Words of plain Latin letters, with marks after them or not, are put together from the ids of their lowered letters and those of
    their marks: for them the normaliser does no more than lower letters, and the pre-tokeniser cuts between letters and marks. What
    is remembered is these pieces, of which there are fewer than words; new ones of letters go to the library's model as they are,
    by their bytes as the pre-tokeniser writes them, and all others to the whole tokeniser.
    """

    def __init__(self, path: str, split_safe: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has given the cores out already
        self.tokenizer = self.load(path)
        self.model = self.tokenizer.model
        self.cuts = bool(self.model.end_of_word_suffix)
        in_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytes = str.maketrans({c: in_bytes(c)[0][0] for c in LETTERS})
        self.split_safe, self.recent = split_safe, Recent(self.each if self.cuts else self.whole, CACHE_WORDS)

    @staticmethod
    def load(path: str) -> Tokenizer:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, pieces: list[str]) -> list[bytes]:
        ids, upto, odd, plain, tokenize = [], [0], [], re.compile(PLAIN).fullmatch, self.model.tokenize
        for i, w in enumerate(pieces):
            if w.isascii() and w.isalpha():
                ids += [t.id for t in tokenize(w)]
            elif plain(w):
                ids += [t.id for t in tokenize(w.translate(self.bytes))]
            else:
                odd.append(i)
            upto.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        rows = [raw[a:b] for a, b in pairwise(upto)]
        for i, b in zip(odd, self.whole([pieces[i] for i in odd]), strict=True):
            rows[i] = b
        return rows

    def of_words(self, words: pa.Array) -> pa.LargeListArray:
        """The ids of each word."""
        if not self.cuts:
            names = strings(words)
            return id_lists(list(map(self.recent.lookup([names]), names)))
        letters = pc.utf8_rtrim(words, MARKS)
        plain = pc.match_substring_regex(letters, f"^{PLAIN}$")
        first, marks = pc.if_else(plain, pc.utf8_lower(letters), words), pc.if_else(plain, pc.utf8_ltrim(words, LETTERS), "")
        pieces = pa.concat_arrays([first, marks]).dictionary_encode()
        names = strings(pieces.dictionary)
        held = id_lists(list(map(self.recent.lookup([names]), names)))
        both = held.take(pa.array(pieces.indices.to_numpy().reshape(2, -1).T.ravel()))
        sizes = pc.list_value_length(both).to_numpy().reshape(-1, 2).sum(axis=1)
        return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), both.flatten())

    def encode(self, texts: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray]:
        """The ids of all texts in a row, with end_id after each, and where those of each text end."""
        if self.split_safe:
            words, at, ends = word_arrays(texts)
            held = self.of_words(words)
        else:
            held, at, ends = id_lists(self.whole(texts.to_pylist())), np.arange(len(texts)), np.arange(1, len(texts) + 1)
        held = pa.concat_arrays([held, id_lists([np.array([end_id], "<u4").tobytes()])])
        at = np.insert(at.astype(np.int64), ends, len(held) - 1)
        counts = np.cumsum(pc.list_value_length(held).to_numpy()[at])
        return held.take(pa.array(at)).flatten(), counts[ends + np.arange(len(ends))]


def id_lists(rows: list[bytes]) -> pa.LargeListArray:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(rows), "<i4")))


@lru_cache(maxsize=2)
def encoder(path: str, split_safe: bool) -> WordEncoder:
    """One per worker process and file."""
    return WordEncoder(path, split_safe)


def write(df: DataFrame, path: str, vocab_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", split_safe: bool = True, options: dict | None = None) -> None:
    """Encode every whole text, append end_id, write ORC below path in ascending order of the ids.

    Columns: id_col, file_no int, file_start long (ids before the row in its file), n_ids int, ids array<int>.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file_no, at = encoder(vocab_path, split_safe).encode, TaskContext.get().partitionId(), 0
        for part, texts in text_parts(batches, 1, SLICE_CHARS):
            ids, ends = encode(texts, end_id)
            ends = np.concatenate([[0], ends])
            rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
            yield pa.record_batch([part.column(0), pa.array(np.full(len(rows), file_no, np.int32)), pa.array(at + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int32()), rows], names=[id_col, "file_no", "file_start", "n_ids", "ids"])
            at += int(ends[-1])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("file_no", T.IntegerType()), T.StructField("file_start", T.LongType()), T.StructField("n_ids", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    order = [F.col(c).asc_nulls_first() for c in (id_col, text_col)]
    ordered = df.select(id_col, text_col).repartitionByRange(order[0]).sortWithinPartitions(*order)
    ordered.mapInArrow(run, schema).write.options(**ORC, **{"orc.bloom.filter.columns": id_col}, **(options or {})).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids) of all rows, or of those with the given ids; these are looked up by metadata and Bloom filters.

    start is the number of ids in all rows before, in the order of the files.
    """
    rows = spark.read.orc(path)
    files = rows.groupBy("file_no").agg(F.max(F.col("file_start") + F.col("n_ids")).alias("held"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    manifest = files.select("file_no", F.coalesce(F.sum("held").over(before), F.lit(0)).cast("long").alias("base"))
    if doc_ids is not None:
        rows = rows.where(F.col(id_col).isin(doc_ids))
    number = len(rows.inputFiles())
    manifest = F.broadcast(manifest) if number <= MANIFEST_ROWS else manifest
    return rows.join(manifest, "file_no").select(id_col, (F.col("base") + F.col("file_start")).alias("start"), "ids")


def digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of rows from read()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            ends = ids.offsets.to_numpy().astype(np.int64)
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([T.StructField(id_col, tokens.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])
    return tokens.select(id_col, "start", "ids").mapInArrow(run, schema)


def round_trip(df: DataFrame, vocab_path: str, **options) -> DataFrame:
    """Write the token files to the shared folder and return the digests of what is read back."""
    spark = df.sparkSession
    path = runtime.work_path(spark, "tokens")
    write(df, path, vocab_path, **options)
    return digests(read(spark, path))
