"""Binary trie self-join: which 64-bit values differ in few bits.

The values of a group, sorted, are the leaves of a binary trie; a node is a range of
them. The join walks down pairs of nodes together: from a pair it goes to the pairs of
children, adds one to the differing bits where the two branch apart, and drops a pair
as soon as the budget is exceeded. All pairs of one depth are handled as arrays.

Only which values hang together is wanted, not every pair. So the walk is made with
rising budgets, and a pair of nodes whose leaves all belong to one component already is
dropped as well: a dense ball of values costs little more than its closest pairs.
"""

from __future__ import annotations

import numpy as np

BITS = 64
# Node pairs handled at once, and pairs of leaves below which a node pair is compared directly.
CHUNK = 1 << 18
DIRECT = 64


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of a[i] and b[i]; labels[i] is the smallest index reachable."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels[:] = jumped


class _Trie:
    def __init__(self, values: np.ndarray, labels: np.ndarray):
        self.values, self.labels = values, labels
        self.ones: dict[int, np.ndarray] = {}
        self.refresh()

    def refresh(self) -> None:
        """Count label changes, so that a range has one label iff its ends have one count."""
        change = np.zeros(len(self.labels), np.int64)
        np.cumsum(self.labels[1:] != self.labels[:-1], out=change[1:])
        self.change = change

    def middle(self, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the branch of bit one begins in nodes of this depth."""
        if depth not in self.ones:
            bit = (self.values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate(([0], np.cumsum(bit, dtype=np.int64))).astype(np.int32)
        ones = self.ones[depth]
        return hi - (ones[hi] - ones[lo])


def _pairs_of(alo, ahi, blo, bhi):
    """All leaf pairs of the given node pairs."""
    wide = bhi - blo
    count = (ahi - alo) * wide
    which = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return alo[which] + at // wide[which], blo[which] + at % wide[which]


def link(values: np.ndarray, roots: list[np.ndarray], depth: int, budget: int) -> np.ndarray:
    """Component labels of ``values`` under "differ in at most ``budget`` bits".

    values  uint64, sorted and distinct inside each group
    roots   arrays alo, ahi, blo, bhi: the node pairs to start from; a pair of equal
            ranges is a self-join
    depth   number of leading bits in which the values of a start node agree, or which
            the caller has already compared with no difference
    """
    labels = np.arange(len(values))
    if not len(values):
        return labels
    for limit in range(1, budget + 1):
        trie = _Trie(values, labels)
        stack = [(depth, *roots, np.zeros(len(roots[0]), np.int64))]
        while stack:
            d, alo, ahi, blo, bhi, used = stack.pop()
            if len(alo) > CHUNK:
                half = len(alo) // 2
                stack += [(d, *(x[:half] for x in (alo, ahi, blo, bhi, used)))]
                alo, ahi, blo, bhi, used = (x[half:] for x in (alo, ahi, blo, bhi, used))
                if len(alo) > CHUNK:
                    stack += [(d, alo, ahi, blo, bhi, used)]
                    continue
            one = (
                (labels[alo] == labels[blo])
                & (trie.change[alo] == trie.change[ahi - 1]) & (trie.change[blo] == trie.change[bhi - 1])
            )
            alo, ahi, blo, bhi, used = (x[~one] for x in (alo, ahi, blo, bhi, used))
            small = (ahi - alo) * (bhi - blo) <= DIRECT
            if small.any():
                i, j = _pairs_of(*(x[small] for x in (alo, ahi, blo, bhi)))
                near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= limit)
                if near.any():
                    unite(labels, i[near], j[near])
                    trie.refresh()
            alo, ahi, blo, bhi, used = (x[~small] for x in (alo, ahi, blo, bhi, used))
            if not len(alo):
                continue
            am, bm = trie.middle(d, alo, ahi), trie.middle(d, blo, bhi)
            same = alo == blo
            children = [
                (alo, am, blo, bm, used, None), (am, ahi, bm, bhi, used, None),
                (alo, am, bm, bhi, used + 1, None), (am, ahi, blo, bm, used + 1, ~same),
            ]
            parts = []
            for c_alo, c_ahi, c_blo, c_bhi, c_used, only in children:
                keep = (c_ahi > c_alo) & (c_bhi > c_blo) & (c_used <= limit)
                if only is not None:
                    keep &= only
                parts.append([x[keep] for x in (c_alo, c_ahi, c_blo, c_bhi, c_used)])
            stack.append((d + 1, *(np.concatenate(x) for x in zip(*parts))))
    return labels
