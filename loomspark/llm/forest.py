"""Signature trees of many blocks of texts, joined by one dual traversal.

A text is its set of tokens, numbers of 32 bits; of small sets only the high 16 count, the others are 0. Every block has a tree: its texts, ordered by size and bitmap, are the entries of the
lowest level; a node above holds the OR of its children's bitmaps, the range of their sizes and the range of their
components' labels. All trees of a forest lie in common arrays, level by level, so that one traversal visits the node pairs
of all blocks at once. It starts with each root paired with itself (or with the root of the same block in another
forest) and descends into those pairs only

* whose sizes allow the threshold,
* whose greatest possible overlap, the bits they have in common and the tokens without a bit of their own, allows it, and
* whose texts aren't all of one component already.

Pairs of entries that are left are compared exactly, by the sets.
"""

from __future__ import annotations

import numpy as np

FAN_OUT = 8
#: Sets of up to so many tokens have 16 bits of each.
NARROW = 2048
BITS = 512
#: Pairs of nodes, and of entries, that are looked at together; this bounds the memory.
PART, COMPARED = 1024, 4096
#: A block of more entries is first held against a few of its own, as most of a hot group is near any of its members.
LARGE, PIVOTS = 64, 3


class Labels:
    """Components of entries: union and find on an array."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.of[self.of]
            if (up == self.of).all():
                return up
            self.of = up

    def _root(self, x: int) -> int:
        of = self.of
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self._root(x), self._root(y)
        if x == y:
            return False
        self.of[max(x, y)] = min(x, y)
        return True


class Forest:
    def __init__(self, block: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, levels: int = 0):
        """``block`` of each text, rising; the texts' sorted ``tokens`` (uint32), joined; the ``sizes`` of the sets."""
        n, self.tokens, self.sizes = len(block), tokens, sizes
        self.wide = sizes > NARROW
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        bit = ((tokens >> np.uint32(16)) * np.uint32(40503) >> np.uint32(7)) % np.uint32(BITS)
        bits = np.zeros((n, BITS), bool)
        bits[np.repeat(np.arange(n), sizes), bit] = True
        bits = np.packbits(bits, 1).view(np.uint64)
        self.order = np.lexsort((bits[:, 0], sizes, block))
        block, bits, size = block[self.order], bits[self.order], sizes[self.order].astype(np.int64)
        excess = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        #: For each level, from the entries up: bitmaps, least and greatest size, greatest excess; and the first child of each node of the level above.
        self.levels, self.first, at = [(bits, size, size, excess)], [], block
        blocks = len(np.unique(block))
        while len(at) > blocks or len(self.levels) < levels:
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            begin = np.flatnonzero(new)
            place = np.arange(len(at)) - begin[np.cumsum(new) - 1]
            begin = np.flatnonzero(place % FAN_OUT == 0)
            b, lo, hi, ex = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(b, begin), np.minimum.reduceat(lo, begin), np.maximum.reduceat(hi, begin), np.maximum.reduceat(ex, begin)))
            self.first.append(np.append(begin, len(at)))
            at = at[begin]

    def label_ranges(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        lo = hi = labels[self.order]
        out = [(lo, hi)]
        for first in self.first:
            lo, hi = np.minimum.reduceat(lo, first[:-1]), np.maximum.reduceat(hi, first[:-1])
            out.append((lo, hi))
        return out


def _possible(a, b, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the greatest possible overlap and the sizes of node pairs allow the threshold."""
    (ab, alo, ahi, aex), (bb, blo, bhi, bex) = a, b
    most = np.bitwise_count(ab[x] & bb[y]).sum(1, dtype=np.int64) + np.minimum(aex[x], bex[y])
    return (most >= threshold / (1 + threshold) * (alo[x] + blo[y]) - 1e-9) & (np.maximum(alo[x], blo[y]) * threshold <= np.minimum(ahi[x], bhi[y]) + 1e-9)


def candidates(a: Forest, b: Forest, threshold: float, labels=None):
    """Dual traversal, depth first: arrays of pairs of entries (in the forests' own order) that may reach the threshold.

    ``labels`` gives the ranges of labels of both forests' nodes as they are when a part is looked at, or None.
    """
    top = len(a.levels) - 1
    roots = np.arange(len(a.levels[top][1]))
    parts = [(top, roots, roots)]
    while parts:
        level, x, y = parts.pop()
        keep = _possible(a.levels[level], b.levels[level], x, y, threshold)
        if labels is not None:
            (alo, ahi), (blo, bhi) = labels[0][level], labels[1][level]
            keep &= (alo[x] != ahi[x]) | (blo[y] != bhi[y]) | (alo[x] != blo[y])
        x, y = x[keep], y[keep]
        if not level:
            if a is b:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
            continue
        fa, fb = a.first[level - 1], b.first[level - 1]
        kids = np.arange(FAN_OUT)
        for at in range(0, len(x), PART):
            p, q = x[at : at + PART], y[at : at + PART]
            cx = (fa[p][:, None] + kids)[:, :, None].repeat(FAN_OUT, 2)
            cy = (fb[q][:, None] + kids)[:, None, :].repeat(FAN_OUT, 1)
            ok = (cx < fa[p + 1][:, None, None]) & (cy < fb[q + 1][:, None, None])
            if a is b:
                ok &= cx <= cy
            parts.append((level - 1, cx[ok], cy[ok]))


def _flat(f: Forest, of: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of some texts with the place of their text above them, rising."""
    n = f.sizes[of].astype(np.int64)
    which = np.repeat(np.arange(len(of)), n)
    at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(f.starts[of], n)
    tokens = f.tokens[at] if mask is None else f.tokens[at] & mask[which]
    return (which << 32) | tokens.astype(np.int64), n


def similar(a: Forest, b: Forest, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Exact comparison of pairs of texts (in the order they came in); a text without tokens is like no other."""
    wide_x, wide_y = a.wide[x], b.wide[y]
    mixed = wide_x != wide_y
    mask = np.where(mixed, np.uint32(0xFFFF0000), np.uint32(0xFFFFFFFF)) if mixed.any() else None
    kx, nx = _flat(a, x, mask)
    ky, ny = _flat(b, y, mask)
    if not len(kx) or not len(ky):
        return np.zeros(len(x), bool)
    if mask is not None:
        ky = ky[np.append(True, ky[1:] != ky[:-1])]
    at = np.minimum(np.searchsorted(kx, ky), len(kx) - 1)
    common = np.bincount(ky[kx[at] == ky] >> 32, minlength=len(x))
    return (common > 0) & (common * (1 + threshold) >= threshold * (nx + ny) - 1e-9)


def _compare(a, b, x, y, threshold, labels, place_b, out) -> None:
    """Adds the links among pairs of texts to ``out`` and joins their labels."""
    for at in range(0, len(x), COMPARED):
        p, q = x[at : at + COMPARED], y[at : at + COMPARED]
        root = labels.roots()
        apart = root[p] != root[q + place_b]
        p, q = p[apart], q[apart]
        good = similar(a, b, p, q, threshold)
        for i, j in zip(p[good].tolist(), q[good].tolist()):
            if labels.join(i, j + place_b):
                out.append((i, j))


def links_within(forest: Forest, block: np.ndarray, threshold: float) -> tuple[list[tuple[int, int]], Labels]:
    """A spanning set of the links inside each block, as places of the texts as they came in; and their components."""
    labels, out = Labels(len(block)), []
    begin = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begin, len(block)))
    large = counts > LARGE
    inverse = np.empty(len(block), np.int64)
    inverse[forest.order] = np.arange(len(block))
    level = forest.levels[0]
    for _ in range(PIVOTS if large.any() else 0):
        root = labels.roots()
        # The first text of each large block that isn't of the first's component, or the first itself.
        for s, n in zip(begin[large].tolist(), counts[large].tolist()):
            single = np.flatnonzero(root[s : s + n] == np.arange(s, s + n)) + s
            pivot = next((int(i) for i in single if i != s), s) if _ else s
            rest = np.arange(s, s + n)
            rest = rest[root[rest] != root[pivot]]
            ok = _possible(level, level, np.full(len(rest), inverse[pivot]), inverse[rest], threshold)
            rest = rest[ok]
            _compare(forest, forest, np.full(len(rest), pivot), rest, threshold, labels, 0, out)
    ranges = forest.label_ranges(labels.roots()) if large.any() else None
    for x, y in candidates(forest, forest, threshold, (ranges, ranges) if ranges else None):
        _compare(forest, forest, forest.order[x], forest.order[y], threshold, labels, 0, out)
    return out, labels


def links_between(a: Forest, b: Forest, threshold: float) -> list[tuple[int, int]]:
    """A spanning set of the links between the texts of equal blocks of two forests (of as many blocks and levels)."""
    out: list[tuple[int, int]] = []
    labels = Labels(len(a.sizes) + len(b.sizes))
    for x, y in candidates(a, b, threshold):
        _compare(a, b, a.order[x], b.order[y], threshold, labels, len(a.sizes), out)
    return out
