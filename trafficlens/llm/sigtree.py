"""Signature trees: which sets of a group are similar, by traversing two trees of OR-combined token bitmaps.

A leaf holds a set's bitmap; a node over FAN neighbours holds the OR of their bitmaps, their range of sizes and
the largest excess of tokens over set bits. No two sets below two nodes can share more tokens than the common bits of the nodes and the
smaller excess; pairs of nodes that cannot reach the similarity, or whose sizes are too far apart, or whose sets are
all linked to each other already, are dropped with everything below. What is left is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Similarity of at least PERCENT / 100.
PERCENT = 80
FAN = 8
#: Pairs of nodes that are compared at once.
CHUNK = 1 << 13
MIN_BITS, MAX_BITS = 256, 1 << 16


def needed(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least overlap of two sets whose sizes add up to ``sizes``."""
    return -(-percent * sizes // (100 + percent))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """``a`` and ``b`` are sorted and distinct."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


class Links:
    """Which of ``n`` sets are linked, directly or through others."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def add(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up


class Tree:
    """Levels from the leaves up; ``order`` tells which set each leaf is."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, bitmaps: np.ndarray, keys: np.ndarray, height: int):
        """A row of ``sizes``, ``bitmaps`` and ``keys`` per member. Sets of like size and the same key stand together."""
        place = np.lexsort((keys, (np.log2(sizes) * 3).astype(np.int64)))
        self.order, sizes, bitmaps = members[place], sizes[place], bitmaps[place]
        excess = sizes - np.bitwise_count(bitmaps).sum(axis=1).astype(np.int64)
        self.levels = [(bitmaps, sizes, sizes, excess)]
        for _ in range(height):
            bitmaps, low, high, excess = self.levels[-1]
            starts = np.arange(0, len(low), FAN)
            self.levels.append((
                np.bitwise_or.reduceat(bitmaps, starts, axis=0), np.minimum.reduceat(low, starts),
                np.maximum.reduceat(high, starts), np.maximum.reduceat(excess, starts),
            ))

    def labels(self, roots: np.ndarray) -> list[np.ndarray]:
        """Per level and node: the common root of all sets below, or -1."""
        out = [roots[self.order]]
        for _ in self.levels[1:]:
            starts = np.arange(0, len(out[-1]), FAN)
            low, high = np.minimum.reduceat(out[-1], starts), np.maximum.reduceat(out[-1], starts)
            out.append(np.where((low == high) & (low >= 0), low, -1))
        return out


def _children(parents: np.ndarray, n: int) -> np.ndarray:
    """FAN columns of children, -1 where there are none."""
    out = parents[:, None] * FAN + np.arange(FAN)
    return np.where(out < n, out, -1)


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    marks = np.zeros(bits, dtype=bool)
    marks[(own & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks).view(np.uint64)


def traverse(a: Tree, b: Tree, check: Callable[[int, int], bool] | None, links: Links, percent: int = PERCENT) -> None:
    """Link all pairs of a set of ``a`` and a set of ``b`` (which may be ``a`` itself) that pass ``check``.

    Without ``check``, all pairs that the bitmaps do not rule out.
    """
    same = a is b
    top = len(a.levels) - 1
    stack = [(top, *(x.ravel() for x in np.meshgrid(np.arange(len(a.levels[top][1])), np.arange(len(b.levels[top][1])), indexing="ij")))]
    while stack:
        level, left, right = stack.pop()
        if len(left) > CHUNK:
            stack += [(level, left[i : i + CHUNK], right[i : i + CHUNK]) for i in range(0, len(left), CHUNK)]
            continue
        roots = links.roots()
        label_a = a.labels(roots)[level]
        label_b = label_a if same else b.labels(roots)[level]
        open_pair = (label_a[left] != label_b[right]) | (label_a[left] < 0)
        if same:
            open_pair &= (left <= right) if level else (left < right)
        left, right = left[open_pair], right[open_pair]
        bits_a, low_a, high_a, excess_a = a.levels[level]
        bits_b, low_b, high_b, excess_b = b.levels[level]
        near = (100 * high_a[left] >= percent * low_b[right]) & (100 * high_b[right] >= percent * low_a[left])
        left, right = left[near], right[near]
        common = np.bitwise_count(bits_a[left] & bits_b[right]).sum(axis=1).astype(np.int64)
        most = common + np.minimum(excess_a[left], excess_b[right])
        able = most >= needed(low_a[left] + low_b[right], percent)
        left, right = left[able], right[able]
        if level:
            down_a, down_b = _children(left, len(a.levels[level - 1][1])), _children(right, len(b.levels[level - 1][1]))
            left, right = np.repeat(down_a, FAN, axis=1).ravel(), np.tile(down_b, FAN).ravel()
            real = (left >= 0) & (right >= 0)
            stack.append((level - 1, left[real], right[real]))
            continue
        for i, j in zip(a.order[left].tolist(), b.order[right].tolist()):
            if links.root(i) != links.root(j) and (check is None or check(i, j)):
                links.add(i, j)


def _height(n: int) -> int:
    height = 0
    while FAN ** (height + 1) < n:
        height += 1
    return height


def _tree_of_sets(sets: list[np.ndarray], members: np.ndarray, bits: int) -> Tree:
    own = [sets[i] for i in members]
    sizes = np.array([len(s) for s in own], dtype=np.int64)
    keys = np.array([s[0] for s in own], dtype=np.uint64)
    return Tree(members, sizes, np.array([bitmap(s, bits) for s in own]), keys, _height(len(sets)))


def _bits(sets: list[np.ndarray]) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (4 * int(np.median([len(s) for s in sets]))).bit_length()))


def link_all(sets: list[np.ndarray], first: int | None = None, percent: int = PERCENT) -> Links:
    """Links among ``sets`` (sorted, not empty). All are compared with ``first`` before the tree is built."""
    links = Links(len(sets))
    if first is not None:
        for i in range(len(sets)):
            if i != first and similar(sets[first], sets[i], percent):
                links.add(first, i)
    if len(np.unique(links.roots())) > 1:
        tree = _tree_of_sets(sets, np.arange(len(sets)), _bits(sets))
        traverse(tree, tree, lambda i, j: similar(sets[i], sets[j], percent), links, percent)
    return links


def link_between(sets: list[np.ndarray], hosts: np.ndarray, visitors: np.ndarray, percent: int = PERCENT) -> Links:
    """Links between sets of ``hosts`` and sets of ``visitors`` (positions)."""
    links = Links(len(sets))
    if len(hosts) and len(visitors):
        bits = _bits(sets)
        trees = _tree_of_sets(sets, hosts, bits), _tree_of_sets(sets, visitors, bits)
        traverse(*trees, lambda i, j: similar(sets[i], sets[j], percent), links, percent)
    return links


def signature(own: np.ndarray) -> bytes:
    """A bitmap of at least two bits per token; its length is a power of two."""
    return bitmap(own, min(MAX_BITS, max(64, 1 << (2 * len(own) - 1).bit_length()))).tobytes()


def _folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] | bitmaps[:, half:]
    return bitmaps


def candidates(signatures: list[bytes], sizes: np.ndarray, percent: int = PERCENT) -> Links:
    """Sets that their signatures do not rule out as similar, linked.

    Similar sets have signatures of the same length or of neighbouring lengths, of which the longer one is folded.
    """
    links = Links(len(signatures))
    lengths = np.array([len(s) // 8 for s in signatures])

    def tree(members: np.ndarray, words: int) -> Tree:
        own = np.array([np.frombuffer(signatures[i], dtype=np.uint64) for i in members])
        return Tree(members, sizes[members], _folded(own, words), own[:, 0], _height(len(signatures)))

    for words in np.unique(lengths).tolist():
        own, longer = np.flatnonzero(lengths == words), np.flatnonzero(lengths == 2 * words)
        shorter = tree(own, words)
        traverse(shorter, shorter, None, links, percent)
        if len(longer):
            traverse(shorter, tree(longer, words), None, links, percent)
    return links
