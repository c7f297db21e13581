"""Sketches of sets as bit strings and a self-join of them over a binary trie.

Every member of a set flips the bit of the sketch that its hash names. Two sketches differ
in at most as many bits as the sets differ in members, so sets of a and b members with a
Jaccard similarity of at least t differ in no more than (1 - t) / (1 + t) * (a + b) bits: pruning by
that Hamming budget loses no pair.

A sketch grows with its set, or unlike sets would differ in too few bits for any budget to tell: it has at least three bits for
two members, up to 2,048 (sets beyond 1,365 members are pruned less, never wrongly). Bits are named by the low bits of a hash, so a sketch is brought to
half its length by folding one half onto the other; sets within t of each other in size differ in length by little.
"""

from __future__ import annotations

import math

import numpy as np

from mendframe.llm.shingles import Shingles, mix

#: Words of the shortest sketches and how often their length may double.
WORDS, LEVELS = 4, 3
#: Node pairs with no more than so many pairs of sketches are compared outright.
LEAF = 64


def levels(size: np.ndarray) -> np.ndarray:
    """How often the sketch of a set of each size is doubled in length."""
    need = 1.5 * np.maximum(size, 1) / (64 * WORDS)
    return np.clip(np.ceil(np.log2(need)), 0, LEVELS).astype(np.int64)


def sketches(s: Shingles, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat words, words of each row) of the sketches of distinct shingles."""
    width = WORDS << levels(size)
    out = np.zeros(int(width.sum()), np.uint64)
    if len(s.hash):
        bit = mix(s.hash ^ np.uint64(0xA24BAED4963EE407)) & (width[s.row] * 64 - 1).astype(np.uint64)
        cell = (np.cumsum(width) - width)[s.row] + (bit >> np.uint64(6)).astype(np.int64)
        np.bitwise_xor.at(out, cell, np.uint64(1) << (bit & np.uint64(63)))
    return out, width


def folded(words: np.ndarray, times: int) -> np.ndarray:
    """Sketches (rows, words) brought to half their length so many times."""
    for _ in range(times):
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _expand(la: np.ndarray, na: np.ndarray, lb: np.ndarray, nb: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of each node pair of starts and lengths; of a node with itself, i < j only."""
    count = na * nb
    at = np.arange(count.sum(), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)
    wide = np.repeat(nb.astype(np.int32), count)
    row = at // wide
    i = np.repeat(la.astype(np.int32), count) + row
    j = np.repeat(lb.astype(np.int32), count) + (at - row * wide)
    if same.any():
        keep = np.repeat(~same, count) | (i < j)
        i, j = i[keep], j[keep]
    return i, j


def _range_max(size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Greatest size in each non-empty range."""
    if not len(lo):
        return np.zeros(0, np.int64)
    return np.maximum.reduceat(np.append(size, 0), np.column_stack((lo, hi)).reshape(-1))[::2]


def join(sketch: np.ndarray, size: np.ndarray, roots: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], t: float, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of every pair of rows under ``roots`` that the budget doesn't exclude.

    ``sketch`` is sorted by its words within each root; ``roots`` has (lo_a, hi_a, lo_b, hi_b)
    arrays of row ranges, a range with itself meaning its pairs i < j. Node pairs descend
    together bit by bit: children of equal bits keep their count of differing bits, children
    of different bits have one more, and a pair of nodes over budget is left with all below it.
    """
    ratio, bits = (1 - t) / (1 + t), 64 * sketch.shape[1]
    la, ha, lb, hb = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*roots)) if roots else [np.zeros(0, np.int64)] * 4
    diff = np.zeros(len(la), np.int64)
    # The largest set under a root bounds the budget of every node below it.
    most = np.maximum(_range_max(size, la, ha), _range_max(size, lb, hb))
    budget = np.floor(ratio * 2 * most + 1e-9).astype(np.int64)
    left, right = [], []

    words = [np.ascontiguousarray(w) for w in sketch.T]

    def compare(k: np.ndarray) -> None:
        pairs = (ha[k] - la[k]) * (hb[k] - lb[k])
        cut = np.searchsorted(np.cumsum(pairs), np.arange(step, pairs.sum() + step, step), side="left")
        for part in np.split(k, np.unique(cut)[:-1] + 1) if len(cut) > 1 else [k]:
            i, j = _expand(la[part], ha[part] - la[part], lb[part], hb[part] - lb[part], (la[part] == lb[part]) & (ha[part] == hb[part]))
            a, b = size[i], size[j]
            ok = np.minimum(a, b) >= t * np.maximum(a, b) - 1e-9
            left_over = np.floor(ratio * (a + b) + 1e-9).astype(np.int32)[ok]
            i, j = i[ok], j[ok]
            for n, w in enumerate(words):  # bits add up word by word, pairs over budget drop out
                left_over -= np.bitwise_count(w[i] ^ w[j])
                if n:
                    ok = left_over >= 0
                    i, j, left_over = i[ok], j[ok], left_over[ok]
            left.append(i.astype(np.int64))
            right.append(j.astype(np.int64))

    for depth in range(bits + 1):
        if not len(la):
            break
        small = (ha - la) * (hb - lb) <= LEAF if depth < bits else np.ones(len(la), bool)
        if small.any():
            compare(np.flatnonzero(small))
            la, ha, lb, hb, diff, budget = (x[~small] for x in (la, ha, lb, hb, diff, budget))
            if not len(la):
                break
        zero = ((words[depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)) == 0
        zeros = np.concatenate(([0], np.cumsum(zero)))
        ma, mb = la + zeros[ha] - zeros[la], lb + zeros[hb] - zeros[lb]
        same = (la == lb) & (ha == hb)
        kids = [(la, ma, lb, mb, 0, None), (ma, ha, mb, hb, 0, None), (la, ma, mb, hb, 1, None), (ma, ha, lb, mb, 1, ~same)]
        parts = []
        for p, q, r, s, more, only in kids:
            keep = (q > p) & (s > r) & (diff + more <= budget)
            if only is not None:
                keep &= only
            parts.append((p[keep], q[keep], r[keep], s[keep], diff[keep] + more, budget[keep]))
        la, ha, lb, hb, diff, budget = (np.concatenate(x) for x in zip(*parts))
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _slots(spread: int) -> list[tuple[int, int]]:
    """Which runs of rows meet: those of the shortest sketches with each other and with each longer ones."""
    return [(0, 0), *(x for u in range(1, spread + 1) for x in ((0, u), (u, 0)))]


def join_levels(level: np.ndarray, word_lists: tuple[np.ndarray, np.ndarray], size: np.ndarray, group: np.ndarray, kind: np.ndarray, kinds: int, meeting: list[tuple[int, int]], t: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of every pair of rows of one group whose kinds meet and that the budget doesn't exclude.

    ``word_lists`` has the flat words of all sketches and where each row's begin. Rows of each length meet one another
    and, folded to that length, the longer ones they may be alike to.
    """
    flat, begin = word_lists
    spread = min(LEVELS, math.ceil(math.log2(1 / t)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in np.unique(level):
        rows, words, up = [], [], []
        for u in range(spread + 1):
            at = np.flatnonzero(level == c + u)
            width = WORDS << int(c + u)
            rows.append(at)
            words.append(folded(flat[begin[at][:, None] + np.arange(width)], u))
            up.append(np.full(len(at), u))
        rows, words, up = np.concatenate(rows), np.concatenate(words), np.concatenate(up)
        slot = (group[rows] * kinds + kind[rows]) * (spread + 1) + up
        order = np.lexsort((*words.T[::-1], slot))
        rows, words, slot = rows[order], words[order], slot[order]
        present = np.unique(group[rows])
        roots = []
        for p, q in meeting:
            for a, b in _slots(spread):
                if p == q and a > b:
                    continue
                ka, kb = ((present * kinds + k) * (spread + 1) + s for k, s in ((p, a), (q, b)))
                lo, hi, lo2, hi2 = (np.searchsorted(slot, k, side) for k, side in ((ka, "left"), (ka, "right"), (kb, "left"), (kb, "right")))
                ok = (hi > lo) & (hi2 > lo2)
                roots.append((lo[ok], hi[ok], lo2[ok], hi2[ok]))
        i, j = join(words, size[rows], roots, t)
        left.append(rows[i])
        right.append(rows[j])
    return np.concatenate(left), np.concatenate(right)
