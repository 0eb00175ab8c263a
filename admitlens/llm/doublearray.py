"""Double-array tries over sequences of dense ids (numpy)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_TRIES = 16  # blocks of free places that are looked through before a family goes behind the last one


@dataclass(frozen=True)
class DoubleArray:
    """The child of place s by id c is place base[s] + c if check there is s. Place 0 is the root; -1 marks a free place, -2 the root."""

    base: np.ndarray
    check: np.ndarray

    def children(self, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Place of each child, or -1."""
        to = self.base[at] + ids
        inside = (to > 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == at), to, -1)

    def walk(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """(depth, sequences that are so long, the place of each) from depth 1 on, for sequences that start in `ids`.

        A sequence that leaves the trie isn't followed any further.
        """
        live = np.flatnonzero(sizes > 0)
        at = np.zeros(len(live), np.int64)
        depth = 0
        while len(live):
            at = self.children(at, ids[starts[live] + depth])
            depth += 1
            yield depth, live[at >= 0], at[at >= 0]
            on = (at >= 0) & (sizes[live] > depth)
            live, at = live[on], at[on]


def _families(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, id) of every node but the root, numbered from 1, level by level; children of a node follow one another."""
    live = np.flatnonzero(sizes > 0)
    at = np.zeros(len(live), np.int64)
    width = int(ids.max(initial=0)) + 1
    parents, labels, made, depth = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 1, 0
    while len(live):
        nodes, which = np.unique(at * width + ids[starts[live] + depth], return_inverse=True)
        parents.append(nodes // width)
        labels.append(nodes % width)
        at = made + which
        made, depth = made + len(nodes), depth + 1
        on = sizes[live] > depth
        live, at = live[on], at[on]
    return np.concatenate(parents), np.concatenate(labels)


def pack(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> DoubleArray:
    """The trie of sequences of ids from 1, `sizes` long from `starts` on in `ids`.

    Families of several children are placed first, the largest before the others, each at the first free place that fits;
    only children then take the free places in their order.
    """
    parent, label = _families(ids, starts, sizes)
    nodes = len(parent) + 1
    of, begin, count = np.unique(parent, return_index=True, return_counts=True)
    used = np.zeros(nodes + int(ids.max(initial=0)) + 2, bool)
    used[0] = True
    place = np.zeros(nodes, np.int64)
    base = np.zeros(nodes, np.int64)
    cursor, end = 1, 1  # no free place before the cursor, no used one from the end on
    for k in sorted(np.flatnonzero(count > 1).tolist(), key=lambda k: -count[k]):
        own = label[begin[k] : begin[k] + count[k]]
        span = int(own[-1] - own[0])
        if end + span + 65 * _TRIES >= len(used):
            used = np.concatenate([used, np.zeros(len(used) + span + 65 * _TRIES, bool)])
        while used[cursor]:
            cursor += 1
        at, spot = cursor, end
        for _ in range(_TRIES):
            free = at + np.flatnonzero(~used[at : at + 64])
            fits = ~used[free[:, None] + (own - own[0])].any(axis=1)
            if fits.any():
                spot = int(free[np.argmax(fits)])
                break
            at += 64
            if at >= end:
                break
        b = spot - int(own[0])
        used[b + own] = True
        end = max(end, spot + span + 1)
        base[of[k]] = b
        place[begin[k] + 1 : begin[k] + 1 + count[k]] = b + own
    only = np.flatnonzero(count == 1)
    if len(used) - int(used.sum()) < len(only):
        used = np.concatenate([used, np.zeros(len(only), bool)])
    spots = np.flatnonzero(~used)[: len(only)]
    place[begin[only] + 1] = spots
    base[of[only]] = spots - label[begin[only]]
    size = int(place.max(initial=0)) + 1
    bases, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    bases[place] = base
    check[place[1:]] = place[parent]
    check[0] = -2
    return DoubleArray(bases, check)
