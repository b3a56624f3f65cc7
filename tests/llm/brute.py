"""Brute-force versions of the contracts, in plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    if len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(zip(*(w[i:] for i in range(n))))


def jaccard(rows, n=4, percent=85):
    """rows: (doc_id, text) -> sorted (doc_id, n_shingles, component_id)."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    at = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            at[g].append(k)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (_, s) in enumerate(sets):
        both = Counter(j for g in s for j in at[g] if j < k)
        for j, c in both.items():
            if 100 * c >= percent * (len(s) + len(sets[j][1]) - c):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def repeats(rows, length=200):
    """rows: (doc_id, text) -> sorted (doc_id, n_bytes, n_removed, n_spans, sha)."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def chats(rows):
    """rows: (conv_id, turn, role, text) -> {conv: (n, sha, chars, sha)}."""
    out = {}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort(key=lambda x: x[0])
        said = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(),
                  len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def top_k(rows, every=20, k=20):
    ok = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q % every == 0:
            s = sorted(((-int(x @ y), j) for j, y in ok if j != q))[:k]
            out += [(q, r + 1, j, -v) for r, (v, j) in enumerate(s)]
    return sorted(out)


def crc(x):
    return zlib.crc32(x) & 0xFFFFFFFF
