"""Row-by-row versions of the operators, for small tables."""

from __future__ import annotations

import re

import numpy as np
import xxhash


def simhash(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    """Smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_pairs(values, budget=3):
    v = np.array(values, dtype=np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1:]) <= budget):
            yield i, i + 1 + int(j)


def shingle_pairs(texts, size=5):
    """Pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} for w in words]
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                yield i, j
