"""Byte-level BPE encoding by speculation and verification, and decoding.

Greedy longest-match proposes a tokenisation of every distinct piece of text; a vectorised test then
checks each adjacent pair of proposed tokens: a pair is compatible if replaying the merges of both tokens
in rank order never lets a merge across their border come first. A proposal whose tokens reproduce
themselves and whose pairs are all compatible is exactly what merging would give. Only pieces that fail go
through exact merging.

Defined cases: a null text counts as empty and gives no ids; the special token's own string in a text gives
its id, as in the tokenizers library; a very long text is encoded whole, as a slice of its own; repeated rows each give a row, and
those that lie together are encoded once; an empty table gives an empty result; any other columns are left out by encode() and
digests() and kept by decode(), whose new column gets a free name.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, id_text_slices, unused

#: Distinct pieces in a generation of what a worker remembers.
CACHE_PIECES = 150_000

#: Fixed value: how the vocabulary's texts are cut before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files use for the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class SpeculativeBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.piece: list[bytes] = [b""] * size
        for s, i in vocab.items():
            if s not in self.special:
                self.piece[i] = to_bytes(s)
        for s, i in self.special.items():
            self.piece[i] = s.encode()
        self.ids = {p: i for i, p in enumerate(self.piece) if p and i not in set(self.special.values())}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            i, j = vocab[a], vocab[b]
            k = vocab[a + b]
            if (i, j) not in self.merge:
                self.merge[i, j] = (r, k)
            if self.rank[k] < 0:
                self.left[k], self.right[k], self.rank[k] = i, j, r
        keys = np.array([i << 32 | j for i, j in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.longest = np.zeros(1 << 16, np.int64)  # longest token by its first two bytes
        for p in self.ids:
            if len(p) > 1:
                self.longest[p[0] << 8 | p[1]] = max(self.longest[p[0] << 8 | p[1]], len(p))
        self.sound = np.zeros(size, np.int8)  # 1: the token's bytes encode to the token; 2: they don't
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(PIECES).findall
        self.recent = Recent(self.learn, CACHE_PIECES)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while i < n:
            size = min(n - i, int(longest[word[i] << 8 | word[i + 1]])) if i + 1 < n else 1
            while size > 1 and word[i : i + size] not in ids:
                size -= 1
            size = max(size, 1)
            out.append(ids[word[i : i + size]])
            i += size
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of adjacent tokens: whether no merge across their border ever comes first.

        The pieces at the border are followed back in time: whichever of the two was made last is replaced by
        its part at the border, and from then on a merge across counts only if it is ranked before that one
        (or equal to it where it is to the right, since merges of one rank go from left to right).
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(x), np.iinfo(np.int64).max)
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            u, v = x[live], y[live]
            key = u << 32 | v
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crosses = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit[live])
            good[live[crosses]] = False
            live, u, v = live[~crosses], u[~crosses], v[~crosses]
            ru, rv = self.rank[u], self.rank[v]
            go = np.maximum(ru, rv) >= 0
            live, u, v, ru, rv = live[go], u[go], v[go], ru[go], rv[go]
            back = ru > rv
            limit[live] = np.where(back, ru, rv + 1)
            x[live], y[live] = np.where(back, self.right[u], u), np.where(back, v, self.left[v])
        return good

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merges by rank, then from left to right, with a heap over a linked list."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before, merge = list(range(1, n + 1)), list(range(-1, n - 1)), self.merge
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((made, ids[k])):
                    heapq.heappush(heap, (m[0], i, made, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], made))):
                heapq.heappush(heap, (m[0], h, ids[h], made, m[1]))
        return [x for x in ids if x >= 0]

    def learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces; a special token's string is a piece of its own."""
        words = [p.encode() for p in pieces]
        proposals = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((i for p in proposals for i in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        for i in np.unique(flat[self.sound[flat] == 0]):
            self.sound[i] = 1 if self.merge_exactly(self.piece[i]) == [i] else 2
        fails = np.zeros(len(words), bool)
        fails[owner[self.sound[flat] == 2]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        fails[owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        ids, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        out, start = [], 0
        for p, w, bad, end in zip(pieces, words, fails.tolist(), ends, strict=True):
            own = [self.special[p]] if p in self.special else self.merge_exactly(w) if bad else None
            out.append(ids[start:end] if own is None else np.array(own, "<u4").tobytes())
            start = end
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut(t) for t in texts]
        get = self.recent.lookup(cut)
        return [b"".join(map(get, c)) for c in cut]

    def cut(self, text: str) -> list[str]:
        """Pieces of a text; a special token's string is a piece of its own."""
        if self.split is None or not any(s in text for s in self.special):
            return self.pieces(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.pieces(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.pieces(text[at:])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.piece.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> SpeculativeBpe:
    """One per worker process and file."""
    return SpeculativeBpe(path)


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids_le binary): the token ids of every whole text as little-endian unsigned 32-bit integers; no shuffle.

    decoded: with a column of that name, the text decoded from the ids in the same worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocab_path)
        for ids, texts in id_text_slices(batches):
            each = pa.array(texts, pa.string()).dictionary_encode()
            rows = bpe.encode_batch(each.dictionary.to_pylist())
            columns = [pa.array(rows, pa.binary()), *([pa.array(map(bpe.decode, rows), pa.string())] if decoded else [])]
            yield pa.record_batch([ids, *(c.take(each.indices) for c in columns)], names=[id_col, "ids_le", "decoded"][: 1 + len(columns)])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids_le", T.BinaryType()), *([T.StructField("decoded", T.StringType())] if decoded else [])])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids_le") -> DataFrame:
    """All columns of df and ``decoded`` (with underscores, should df have that name), the text of the ids (special tokens kept)."""
    at, into = df.columns.index(ids_col), unused("decoded", df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocab_path)
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                texts = [bpe.decode(x or b"") for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.StringType())]))


def digests(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: the id, n_tokens, the SHA-256 of its ids and of the text decoded from them, and the ids (ids_le) if wanted."""
    done = encode(df, vocab_path, id_col, text_col, decoded=True)
    return done.select(
        id_col,
        F.expr("cast(octet_length(ids_le) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        *(["ids_le"] if with_ids else []),
    )
