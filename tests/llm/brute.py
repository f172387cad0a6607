"""Plain, slow versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def near_duplicates(docs):
    """{doc_id: (n_shingles, component_id)} for unique ids."""
    sets, parent = {}, {}
    for i, text in docs:
        ws = SPACED.findall((text or "").translate(LOWER))
        sets[i] = set(zip(*(ws[k:] for k in range(5)), strict=False)) if len(ws) >= 5 else ({tuple(ws)} if ws else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def contaminated(docs, benchmark, n=10):
    """[(doc_id, n_words, n_hit, items)]"""
    windows = {}
    for i, text in benchmark:
        ws = ALNUM.findall((text or "").translate(LOWER))
        for k in range(max(1, len(ws) - n + 1) if ws else 0):
            windows.setdefault(tuple(ws[k : k + n]), set()).add(str(i))
    sizes, out = {len(x) for x in windows}, []
    for i, text in docs:
        ws = ALNUM.findall((text or "").translate(LOWER))
        hit, items = set(), set()
        for size in sizes:
            for k in range(len(ws) - size + 1):
                if (x := tuple(ws[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    items |= windows[x]
        out.append((i, len(ws), len(hit), sorted(items)))
    return out


def repeats_removed(docs, n=35):
    """[(doc_id, n_words, n_removed, sha256)]"""
    starts, words = {}, [(i, SPACED.findall(t or "")) for i, t in docs]
    for d, (_, ws) in enumerate(words):
        for k in range(len(ws) - n + 1):
            starts.setdefault(tuple(ws[k : k + n]), []).append((d, k))
    gone = [set() for _ in words]
    for places in starts.values():
        if len(places) > 1:
            for d, k in places:
                gone[d] |= set(range(k, k + n))
    return [(i, len(ws), len(gone[d]), sha(" ".join(x for k, x in enumerate(ws) if k not in gone[d]))) for d, (i, ws) in enumerate(words)]
