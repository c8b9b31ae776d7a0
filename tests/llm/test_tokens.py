"""Ops 4 and 10 against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from brute import crc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oakgraph.llm import bpe, token_files

BYTE, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ALPHABET = [chr(c) for c in [*range(0x250), 0x301, 0x85, 0xA0, 0x1680, 0x2000, 0x2028, 0x202F, 0x3000, 0x200B, 0xFEFF, 0x4E00, 0x1F600, 0x660, 0x3A3, 0x3C3, 0x2022]]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


def random_texts(n):
    rng = random.Random(5)
    pools = [ALPHABET, list("abc theinr' \n\t"), list("aab "), list("thes'rd .,!é")]
    return ["".join(rng.choices(rng.choice(pools), k=rng.randint(0, 60))) for _ in range(n)] + ["a" * 3000, "<|endoftext|> x<|endoftext|>", "• x•y"]


def test_speculation_equals_library(byte_library):
    codec, texts = bpe.SpeculativeBpe(BYTE), random_texts(4000)
    got = [np.frombuffer(b, "<u4").tolist() for b in codec.encode_batch(texts)]
    want = [e.ids for e in byte_library.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [codec.decode(np.array(i, "<u4").tobytes()) for i in want] == [byte_library.decode(i, skip_special_tokens=False) for i in want]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aetonishr", min_size=1, max_size=14))
def test_compatible_pairs_are_those_that_merging_keeps(word):
    codec = bpe.codec(BYTE)
    a, b = codec.merge_exactly(word[: len(word) // 2].encode() or b"a"), codec.merge_exactly(word[len(word) // 2 :].encode())
    pair = (a[-1], b[0])
    kept = codec.merge_exactly(codec.piece[pair[0]] + codec.piece[pair[1]]) == list(pair)
    assert bool(codec.compatible(np.array([pair[0]]), np.array([pair[1]]))[0]) == kept


def test_some_words_fail_speculation():
    codec = bpe.codec(BYTE)
    words = [" thereadble", " weather", " atoning", " thinterest", " interestshe"]
    assert any(codec.propose(w.encode()) != codec.merge_exactly(w.encode()) for w in words)


def test_words_equal_library(word_library):
    texts = random_texts(4000)
    ids, ends = token_files.WordEncoder(WORDS).encode(pa.array(texts), 1)
    rows = np.split(ids.to_numpy(), ends[:-1])
    assert [r.tolist() for r in rows] == [[*e.ids, 1] for e in word_library.encode_batch(texts, add_special_tokens=False)]


def test_plain_words_are_put_together_from_letters_and_marks(word_library):
    rng, letters, marks = random.Random(6), token_files.LETTERS, token_files.MARKS
    made = ["".join(rng.choices(letters, k=rng.randint(1, 9))) + "".join(rng.choices(marks, k=rng.choice([0, 1, 3]))) for _ in range(5000)]
    texts = [*letters, *marks, *made, " ".join(made), "Σας ΣΑΣ. x\u0301. ×. a×b ÷ don't. 'S. it's, ab.c ... .a <|endoftext|>. é\u0301,", "a\x1fb.\x85c, d\xa0e", "", " \n "]
    for kind in (pa.string(), pa.large_string()):
        ids, ends = token_files.WordEncoder(WORDS).encode(pa.array(texts, kind), 1)
        assert [r.tolist() for r in np.split(ids.to_numpy(), ends[:-1])] == [[*e.ids, 1] for e in word_library.encode_batch(texts, add_special_tokens=False)]
    assert token_files.WordEncoder(WORDS).encode(pa.array(["", " "]), 1)[0].to_pylist() == [1, 1]


def test_words_that_differ_in_case_and_marks_are_encoded_once():
    encoder, met = token_files.WordEncoder(WORDS), []
    encoder.recent.compute = lambda pieces, f=encoder.recent.compute: met.extend(pieces) or f(pieces)
    encoder.encode(pa.array(["seven, Seven. SEVEN!! seven", "Été. été, seven;"]), 1)
    encoder.encode(pa.array(["Seven! été"]), 1)
    assert sorted(met) == sorted(["seven", "été", "", ",", ".", "!!", ";", "!"])


def check_bpe(df, library):
    want = sorted((str(r["doc_id"]), len(i := library.encode(r["text"] or "", add_special_tokens=False).ids), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r in df.select("doc_id", "text").collect())
    assert sorted((str(r["doc_id"]), *r[1:]) for r in bpe.digests(df, BYTE).collect()) == want


def test_digests(documents, odd, no_documents, byte_library):
    check_bpe(documents, byte_library)
    check_bpe(odd, byte_library)
    assert bpe.digests(no_documents, BYTE).count() == 0


def test_decode_of_stored_ids(documents):
    stored = bpe.encode(documents, BYTE)
    assert stored.columns == ["doc_id", "ids_le"]
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(stored, BYTE).collect()}
    assert got == {r["doc_id"]: r["text"] for r in documents.collect()}
    assert bpe.decode(stored.withColumn("decoded", F.lit(1)).limit(1), BYTE).columns == ["doc_id", "ids_le", "decoded", "decoded_"]


def check_files(df, library):
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: r[0])
    want, start = [], 0
    for i, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(df, WORDS).collect())
    assert got == sorted(want)


def test_files(documents, odd, no_documents, word_library):
    check_files(documents, word_library)
    check_files(odd, word_library)
    assert token_files.round_trip(no_documents, WORDS).count() == 0


def test_rows_that_share_an_id_have_one_order(spark):
    rows = [(1, "alpha beta"), (1, "one two three four five"), (1, None), (2, "x"), (None, "y"), (None, "a b")]
    both = [sorted((str(r[0]), *r[1:]) for r in token_files.round_trip(spark.createDataFrame(x, "doc_id long, text string").repartition(3), WORDS).collect()) for x in (rows, rows[::-1])]
    assert both[0] == both[1] and [(r[1], r[2]) for r in both[0] if r[0] == "1"] != []


def test_lookup_by_id_reads_the_same(spark, documents, tmp_path):
    token_files.write(documents, f"file://{tmp_path}/t", WORDS)
    everything = {r["doc_id"]: (r["start"], r["ids"]) for r in token_files.read(spark, f"file://{tmp_path}/t").collect()}
    assert {r["doc_id"]: (r["start"], r["ids"]) for r in token_files.read(spark, f"file://{tmp_path}/t", [7, 11, 10**9]).collect()} == {i: everything[i] for i in (7, 11)}
