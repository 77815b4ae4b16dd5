"""Deep-shallow sorting of suffixes: multikey quicksort to a shallow depth, blind tries beyond it.

Suffixes are rows of a matrix of symbols (each as many as the sort may need).  The shallow phase splits groups
of equal prefixes symbol by symbol, all groups of a level at once.  Groups that still agree after SHALLOW
symbols have long common prefixes; each goes into a blind trie, whose nodes keep only the position and the
symbol of a branch: a suffix walks down by these symbols alone, is compared once with the leaf it reaches, and
is inserted where the two really part.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 8


class Node:
    __slots__ = ("depth", "branch", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.branch, self.leaf = depth, {}, leaf


def blind_trie_order(rows: np.ndarray, ids: list[int]) -> list[list[int]]:
    """The rows in lexicographic order, equal ones together."""
    width = rows.shape[1]
    text = {i: rows[i] for i in ids}
    same: dict[int, list[int]] = {ids[0]: [ids[0]]}
    root = Node(width, ids[0])
    for i in ids[1:]:
        own = text[i]
        node, path = root, []
        while node.branch:
            path.append(node)
            nxt = node.branch.get(int(own[node.depth]))
            node = nxt if nxt is not None else next(iter(node.branch.values()))
            while nxt is None and node.branch:  # any leaf below tells where the suffix parts
                path.append(node)
                node = next(iter(node.branch.values()))
        other = text[node.leaf]
        differ = own != other
        at = int(differ.argmax())
        if not differ[at]:
            same[node.leaf].append(i)
            continue
        same[i] = [i]
        path.append(node)
        k = next(j for j, x in enumerate(path) if x.depth >= at or not x.branch)
        spot = path[k]
        leaf = Node(width, i)
        if spot.branch and spot.depth == at:
            spot.branch[int(own[at])] = leaf
            continue
        lower = Node(spot.depth, spot.leaf)
        lower.branch = spot.branch
        spot.depth, spot.branch = at, {int(other[at]): lower, int(own[at]): leaf}
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.branch:
            stack += [node.branch[s] for s in sorted(node.branch, reverse=True)]
        else:
            out.append(same[node.leaf])
    return out


def sort_rows(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, symbols), and the common prefix of each with the one before it in its group.

    The prefix is -1 where a group begins.
    """
    n, width = rows.shape
    order = np.argsort(group, kind="stable")
    label = np.zeros(n, np.int64)
    label[1:] = np.cumsum(group[order][1:] != group[order][:-1])
    heads = np.ones(n, bool)
    heads[1:] = label[1:] != label[:-1]
    for d in range(min(SHALLOW, width)):  # multikey quicksort, level by level, over the groups with members left
        size = np.diff(np.append(np.flatnonzero(heads), n))
        slots = np.flatnonzero(np.repeat(size > 1, size))
        if not len(slots):
            break
        own, part = order[slots], label[slots]
        symbol = rows[own, d].astype(np.int64)
        by = np.lexsort((symbol, part))
        order[slots] = own[by]
        symbol, part = symbol[by], part[by]
        split = np.ones(len(slots), bool)
        split[1:] = (symbol[1:] != symbol[:-1]) | (part[1:] != part[:-1])
        heads[slots] = split
        label = np.cumsum(heads) - 1
    bounds = np.append(np.flatnonzero(heads), n)
    wide = np.flatnonzero(np.diff(bounds) > 1)
    if len(wide) and width > SHALLOW:
        # equal rows are one leaf: only distinct ones go through the trie
        view = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * width))).ravel()
        for g in wide:
            lo, hi = bounds[g], bounds[g + 1]
            own = order[lo:hi]
            by: dict[bytes, list[int]] = {}
            for i in own.tolist():
                by.setdefault(view[i].tobytes(), []).append(i)
            if len(by) > 1:
                lead = {members[0]: members for members in by.values()}
                flat = [i for equal in blind_trie_order(rows, list(lead)) for first in equal for i in lead[first]]
                order[lo:hi] = flat
    common = np.full(n, -1, np.int64)
    if n > 1:
        inside = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
        common[inside] = prefix(rows, order[inside], order[inside - 1])
    return order, common


def prefix(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of rows a and b, pair by pair."""
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), 1 << 16):
        differ = rows[a[lo : lo + (1 << 16)]] != rows[b[lo : lo + (1 << 16)]]
        out[lo : lo + (1 << 16)] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out
