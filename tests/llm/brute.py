"""Plain-Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(text: str | None):
    """(n_email, n_ip, n_card, n_phone), base_sha256."""
    found = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), k, m.end()))
    names = list(PII)
    joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(found))
    return [sum(k == i for _, k, _ in found) for i in range(4)], hashlib.sha256(joined.encode()).hexdigest()


def shingles(text: str | None, k: int) -> set:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def components(docs: list[tuple[int | None, str | None]], k: int) -> dict[int, int]:
    sets: dict[int, set] = {}
    parent = {i: i for i, _ in docs if i is not None}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for n, (i, t) in enumerate(docs):
        if i is None:
            continue
        sets[n] = shingles(t, k)
        shared = Counter(m for s in sets[n] for m in index[s])
        for m, c in shared.items():
            if 100 * c >= 80 * (len(sets[n]) + len(sets[m]) - c):
                a, b = find(i), find(docs[m][0])
                parent[max(a, b)] = min(a, b)
        for s in sets[n]:
            index[s].append(n)
    return {i: find(i) for i in parent}


def quality(text: str | None):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered (10 words or more), longest repeat."""
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)

    def cover(m):
        at = defaultdict(list)
        for i in range(len(w) - m + 1):
            at[tuple(w[i : i + m])].append(i)
        return {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + m)}

    longest = next((m for m in range(len(w) - 1, 2, -1) if cover(m)), 0) if len(w) < 400 else None
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover(3)), len(cover(10)), longest


def mix_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * left / total > 3 * sizes[s] + 1e-9]
        if not over:
            return out | {s: weight[s] * left / total for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        free -= set(over)
    return out


def nearest(rows: list[tuple[int | None, list | None]], k: int) -> dict[int, list[tuple[int, float]]]:
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, float))
    out = {}
    for q in (i for i in good if i % 100 == 0):
        found = sorted((float(np.sqrt(((x - good[q][0]) ** 2).sum())), i) for i, vs in good.items() if i != q for x in vs if len(x) == len(good[q][0]))
        out[q] = [(i, d) for d, i in found[:k]]
    return out


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
