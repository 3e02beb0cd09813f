"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def simhash(docs, k=3, budget=2):
    fp = {}
    for i, t in docs:
        w = [x.lower() for x in words(t)]
        grams = [b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    codes = np.array([fp[i] for i in ids], np.uint64)
    for x in range(len(ids)):
        for y in np.flatnonzero(np.bitwise_count(codes[x] ^ codes[x + 1 :]) <= budget) + x + 1:
            a, b = find(ids[x]), find(ids[y])
            root[max(a, b)] = min(a, b)
    return {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def repeats(docs, window=35):
    texts = [words(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, texts, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out, key=str)


def one_edit(a: str, b: str) -> bool:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= 1


def lines(docs, least=5):
    seen, first, out = [], {}, []
    for d, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        own = (t or "").split("\n")
        kept = []
        for x in own:
            if words(x):
                if x in first:
                    continue
                first[x] = least is not None and any(abs(len(o) - len(x)) <= 1 and max(len(o), len(x)) >= least and one_edit(x, o) for o in seen)
                seen.append(x)
                if first[x]:
                    continue
            kept.append(x)
        out.append((d, len(own) if t is not None else 0, len(own) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)
