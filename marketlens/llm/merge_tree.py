"""Segment trees over the positions of many short pieces at once: BPE merges for a whole batch."""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
#: Longest piece (in symbols) that is merged in a batch; its positions take SHIFT bits.
WIDEST = 64
SHIFT = 6


class PairRanks:
    """Rank of a pair of token ids, and the id that the pair merges into."""

    def __init__(self, pairs: dict[tuple[int, int], int], merged_id: np.ndarray | None = None):
        keys = np.fromiter((a << 20 | b for a, b in pairs), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.ranks = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], np.int32(0))
        self.merged_id = merged_id

    def of(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaf values: the rank with the place below it, or NONE."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at] << SHIFT | place, NONE).astype(np.int32)


def merge_many(symbols: np.ndarray, lengths: np.ndarray, table: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of each piece, its symbols merged leftmost pair of the lowest rank first.

    ``symbols`` holds the pieces one after another; the result holds their ids in the same
    way, and the number of ids of each piece. Pieces of similar length share an array with
    one tree per row; each round merges one pair in every row that still has one, and
    updates the three leaves that change and the nodes above them. Pieces have at most
    WIDEST symbols.
    """
    starts = np.cumsum(lengths) - lengths
    sizes = np.zeros(len(lengths), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    low = 0
    for width in (4, 8, 16, 32, 64):
        rows = np.flatnonzero((lengths > low) & (lengths <= width))
        low = width
        for part in range(0, len(rows), 20_000):
            own = rows[part : part + 20_000]
            filled = np.arange(width)[None, :] < lengths[own][:, None]
            token = np.zeros((len(own), width + 1), np.int32)
            token[:, :width][filled] = symbols[(starts[own][:, None] + np.arange(width)[None, :])[filled]]
            ids, sizes[own] = _merge(token, filled, lengths[own], width, table)
            found.append((own, ids))
    places = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.int32)
    for own, ids in found:
        count = sizes[own]
        within = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(places[own], count) + within] = ids
    return out, sizes


def _merge(token: np.ndarray, filled: np.ndarray, n: np.ndarray, width: int, table: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    count = len(n)
    end = np.tile(np.arange(1, width + 2, dtype=np.int32), (count, 1))
    before = np.tile(np.arange(-1, width, dtype=np.int32), (count, 1))
    tree = np.full((count, 2 * width), NONE, np.int32)
    if width > 1:
        places = np.broadcast_to(np.arange(width - 1, dtype=np.int32), (count, width - 1))
        pairs = filled[:, 1:]
        leaves = np.full((count, width - 1), NONE, np.int32)
        leaves[pairs] = table.of(token[:, : width - 1][pairs], token[:, 1:width][pairs], places[pairs])
        tree[:, width : 2 * width - 1] = leaves
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
    alive = filled.copy()
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while rows.size:
        root = tree[rows, 1]
        at, rank = root & ((1 << SHIFT) - 1), root >> SHIFT
        gone = end[rows, at]
        new = rank if table.merged_id is None else table.merged_id[rank]
        token[rows, at] = new
        alive[rows, gone] = False
        after = end[rows, gone]
        end[rows, at] = after
        before[rows, after] = at
        tree[rows, width + gone] = NONE
        right = after < n[rows]
        value = np.full(rows.size, NONE, np.int32)
        value[right] = table.of(new[right], token[rows[right], after[right]], at[right])
        tree[rows, width + at] = value
        has = at > 0
        left = before[rows, at]
        left_rows, left = rows[has], left[has]
        tree[left_rows, width + left] = table.of(token[left_rows, left], new[has], left)
        for who, leaf in ((rows, gone), (rows, at), (left_rows, left)):
            node = (leaf + width) >> 1
            while node.size and node[0]:
                tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
                node = node >> 1
        rows = rows[tree[rows, 1] < NONE]
    return token[:, :width][alive], alive.sum(1)
