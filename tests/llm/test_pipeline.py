"""The pipeline against a brute-force version."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers as P
from brute import PII, WORD, components, luhn, mix_targets
from tokenizers import Tokenizer

import corpus_pipeline


def good(text):
    w = WORD.findall(text or "")
    n = len(w)

    def cover(m):
        at = {}
        for i in range(n - m + 1):
            at.setdefault(tuple(w[i : i + m]), []).append(i)
        return {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + m)}

    return n >= 50 and 100 * len(cover(3)) <= 50 * n and 100 * len(cover(10)) <= 30 * n and not cover(30 * n // 100 + 1)


def masked(text):
    spans = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                spans.append((m.start(), k, m.end(), kind))
    out, at = "", 0
    for start, _, end, kind in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def mixed(docs):
    size = {i: len(WORD.findall(t)) for i, t, _ in docs}
    sizes = {}
    for i, _, s in docs:
        sizes[s] = sizes.get(s, 0) + size[i]
    out = []
    for s, target in mix_targets(sizes).items():
        def key(d):
            u = (int(hashlib.md5(f"mix-1:{d[0]}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            marks = sum(d[1].count(c) for c in "#*$%&|<>")
            return -math.log(u) / max(0.05, 1.0 - 5.0 * marks / max(1, len(d[1])))

        epochs = min(3, int(target // sizes[s] + 1e-9)) if sizes[s] else 0
        rest, before = target - epochs * sizes[s], 0
        for d in sorted((d for d in docs if d[2] == s), key=key):
            extra = epochs < 3 and 2 * before + size[d[0]] <= 2 * rest
            out += [d] * (epochs + extra if size[d[0]] else 0)
            before += size[d[0]]
    return out


def test_run_equals_brute_force(spark, documents, sf):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect() if good(r["text"])]
    parts = components([d[:2] for d in docs], 5)
    docs = mixed([(i, masked(t), s) for i, t, s in docs if parts[i] == i])
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t, _ in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), raw))
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids_le"]
    assert sorted((*r[:4], bytes(r[4])) for r in got.collect()) == sorted(want)


def test_stages_keep_columns_and_stand_odd_rows(spark, odd, sf):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_terms_of_rare_entities_are_masked(spark, sf):
    """Two contexts are enough in a corpus of this size; lone co-occurrences are left alone."""
    rng = random.Random(8)
    filler = lambda: " ".join(f"word{rng.randrange(60)}" for _ in range(30))
    texts = [f"{filler()} Zorblax zed@corp.com {filler()}" for _ in range(2)] + [f"about zorblax, then {filler()}", f"{filler()} Quxom yes@corp.com {filler()}"] + [filler() for _ in range(1400)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["pii"](spark, docs, sf).collect()}
    assert all(out[i] == texts[i].replace("Zorblax", "[TERM]").replace("zed@corp.com", "[EMAIL]") for i in range(2))
    assert out[2] == texts[2].replace("zorblax", "[TERM]") and out[3] == texts[3].replace("yes@corp.com", "[EMAIL]")
    assert all(out[i] == texts[i] for i in range(4, len(texts)))
