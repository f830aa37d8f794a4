"""Betweenness of a directed graph of numbers: blocks of searches at a time.

Only nodes with edges in and out (inner ones) lie between others.  All others
are counts: nodes without edges out are ends, those of the same inner nodes
before them are one group with a size; a node without edges in whose only
inner neighbour is x shares the search of x, whose ends then count for it as well, save
those it has an edge to itself.  Searches of a block are columns of matrices,
a row for each inner node that one of them reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Not reached.
_FAR = np.iinfo(np.int32).max
#: Searches of a block: of those that reach the most central node, and of others.
_WIDE, _NARROW = 32, 256
#: Cells of a matrix of a block, and of what is summed at once (in the processor's cache).
_CELLS, _PART = 4_000_000, 32_000


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)


def _parts(starts: np.ndarray, total: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(first segment, end; first row, end): whole segments, of about ``_PART`` cells."""
    ends = np.r_[starts[1:], total]
    step, s = max(1, _PART // width), 0
    while s < len(starts):
        e = max(s + 1, int(np.searchsorted(ends, starts[s] + step, "right")))
        yield s, e, int(starts[s]), int(ends[e - 1])
        s = e


def _summed(values: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows ``values[at]`` of each segment."""
    out = np.zeros((len(starts), values.shape[1]))
    for s, e, a, b in _parts(starts, len(at), values.shape[1]):
        out[s:e] = np.add.reduceat(values[at[a:b]], starts[s:e] - a, axis=0)
    return out


def _rows_of(first: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of the items of the ``chosen`` lists; list i is first[i] to first[i + 1]."""
    size = first[chosen + 1] - first[chosen]
    return np.arange(size.sum()) + np.repeat(first[chosen] - (np.cumsum(size) - size), size)


class Searches:
    """What tasks need to search from any of the roots.

    ``heads`` and ``tails`` are the edges whose tail has edges out or more than one edge in;
    ``outs`` and ``ins`` count all edges of their nodes.
    """

    def __init__(self, heads: np.ndarray, tails: np.ndarray, outs: np.ndarray, ins: np.ndarray):
        inner = (outs > 0) & (ins > 0)
        self.ids = np.flatnonzero(inner)
        n = len(self.ids)
        at = np.cumsum(inner) - 1
        single = (outs - np.bincount(heads, minlength=len(outs)))[self.ids].astype(float)  # ends with one edge in
        both = inner[heads] & inner[tails]
        a, b = at[heads[both]], at[tails[both]]
        order = np.lexsort((b, a))
        self.head, self.tail = a[order], b[order]
        self.first = np.searchsorted(self.head, np.arange(n + 1))
        self.by_tail = np.lexsort((self.head, self.tail))
        # groups of ends; code: of each end, a group from 0 on, or -2 - x if x is the only inner node before it
        on = inner[heads] & (outs[tails] == 0)
        order = np.lexsort((heads[on], tails[on]))
        h, end = at[heads[on][order]], tails[on][order]
        s = _starts(end)
        k = np.diff(np.r_[s, len(end)])
        code = np.full(len(outs), -1)
        code[end[s[k == 1]]] = -2 - h[s[k == 1]]
        np.add.at(single, h[s[k == 1]], 1)
        pairs, which = np.unique(h[s[k == 2]] * n + h[s[k == 2] + 1], return_inverse=True)
        code[end[s[k == 2]]] = which
        many = s[k > 2]
        code[end[many]] = len(pairs) + np.arange(len(many))
        self.size = np.r_[np.bincount(which, minlength=len(pairs)), np.ones(len(many), np.int64)].astype(float)
        rest = np.repeat(k > 2, k)
        group = np.r_[np.repeat(np.arange(len(pairs)), 2), code[end[rest]]]
        before = np.r_[np.stack([pairs // max(n, 1), pairs % max(n, 1)], 1).ravel(), h[rest]]
        self.group, self.before = group, before  # sorted by group
        self.by_before = np.lexsort((group, before))
        self.single = single
        # roots: the inner nodes, then nodes without edges in that have several inner neighbours
        pure = ~inner[heads] & inner[tails]
        order = np.argsort(heads[pure], kind="stable")
        p, x = heads[pure][order], at[tails[pure][order]]
        s = _starts(p)
        k = np.diff(np.r_[s, len(p)])
        shares = np.full(len(outs), -1)
        shares[p[s[k == 1]]] = x[s[k == 1]]
        shares[p[s[k > 1]]] = n + np.arange((k > 1).sum())
        self.times = np.r_[1 + np.bincount(x[s[k == 1]], minlength=n), np.ones((k > 1).sum(), np.int64)].astype(float)
        self.start_first = np.r_[np.arange(n), n + np.r_[0, np.cumsum(k[k > 1])]]
        self.start = np.r_[np.arange(n), x[np.repeat(k > 1, k)]]
        # ends that a node without edges in has an edge to itself: (root, code) as often as it occurs
        own = (shares[heads] >= 0) & (code[tails] != -1)
        root, what = shares[heads[own]], code[tails[own]]
        order = np.argsort(root, kind="stable")
        self.near = what[order]
        self.near_first = np.searchsorted(root[order], np.arange(len(self.times) + 1))
        self.n = n

    def blocks(self) -> list[np.ndarray]:
        """Roots that are searched together."""
        n = self.n
        roots = np.arange(len(self.times))
        roots = roots[(roots >= n) | (self.times > 1) | (np.diff(self.first) > 0)[np.minimum(roots, n - 1)]] if n else roots
        if not len(roots):
            return []
        outs, ins = np.diff(self.first), np.bincount(self.tail, minlength=n)
        to_hub = np.zeros(n, bool)
        front = np.array([np.argmax((outs + 1.0) * (ins + 1.0))])
        first = np.searchsorted(self.tail[self.by_tail], np.arange(n + 1))
        while len(front):
            to_hub[front] = True
            front = np.unique(self.head[self.by_tail[_rows_of(first, front)]])
            front = front[~to_hub[front]]
        far = np.logical_or.reduceat(to_hub[self.start], self.start_first[:-1])[roots]
        return [x[i : i + k] for x, k in ((roots[far], _WIDE), (roots[~far], _NARROW)) for i in range(0, len(x), k)]

    def add(self, roots: np.ndarray, sums: np.ndarray) -> None:
        """Adds what inner nodes get from the searches of ``roots``."""
        seen = np.zeros(self.n, bool)
        front = np.unique(self.start[_rows_of(self.start_first, roots)])
        while len(front):
            seen[front] = True
            front = np.unique(self.tail[_rows_of(self.first, front)])
            front = front[~seen[front]]
        rows = np.flatnonzero(seen)
        at = np.cumsum(seen) - 1
        here = seen[self.head]
        forth = np.flatnonzero(here)
        back = self.by_tail[here[self.by_tail]]
        met = np.flatnonzero(seen[self.before])
        groups = np.unique(self.group[met])
        group = np.searchsorted(groups, self.group[met])
        by_before = self.by_before[seen[self.before[self.by_before]]]
        graph = (rows, at, (at[self.head[back]], at[self.tail[back]]), (at[self.head[forth]], at[self.tail[forth]]), groups, (group, at[self.before[met]]), (np.searchsorted(groups, self.group[by_before]), at[self.before[by_before]]))
        width = max(1, _CELLS // (len(rows) + len(groups)))
        for i in range(0, len(roots), width):
            self._add(roots[i : i + width], sums, *graph)

    def _add(self, roots, sums, rows, at, by_tail, by_head, groups, by_group, by_before) -> None:
        width = len(roots)
        times = self.times[roots]
        dist, sigma = np.full((len(rows), width), _FAR, np.int32), np.zeros((len(rows), width))
        items = _rows_of(self.start_first, roots)
        column = np.repeat(np.arange(width), self.start_first[roots + 1] - self.start_first[roots])
        begin = at[self.start[items]]
        dist[begin, column], sigma[begin, column] = 0, 1
        levels = [np.unique(begin)]
        place = np.zeros(len(rows), np.int64)

        def gathered(values: np.ndarray, active: np.ndarray, source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(targets, sums of the values of their active sources)."""
            on = np.zeros(len(rows), bool)
            on[active] = True
            place[active] = np.arange(len(active))
            chosen = np.flatnonzero(on[source])
            target = target[chosen]
            starts = _starts(target)
            return target[starts], _summed(values, place[source[chosen]], starts)

        while True:
            d, active = len(levels) - 1, levels[-1]
            to, count = gathered(np.where(dist[active] == d, sigma[active], 0), active, *by_tail)
            fresh = (count > 0) & (dist[to] == _FAR)
            some = fresh.any(axis=1)
            if not some.any():
                break
            to, count, fresh = to[some], count[some], fresh[some]
            dist[to] = np.where(fresh, d + 1, dist[to])
            sigma[to] = np.where(fresh, count, sigma[to])
            levels.append(to)
        reached = dist != _FAR
        single = self.single[rows]
        delta = np.where(reached, single[:, None] * times, 0)
        ends = reached.T @ (1 + single) - 1  # beside the root
        # ends that a source of these searches has an edge to itself
        near = self.near[_rows_of(self.near_first, roots)]
        column = np.repeat(np.arange(width), self.near_first[roots + 1] - self.near_first[roots])
        less = np.zeros(width)
        one = near <= -2
        x, j = -2 - near[one], column[one]
        p = np.minimum(np.searchsorted(rows, x), len(rows) - 1)
        p, j = p[rows[p] == x], j[rows[p] == x]
        x, j = p[reached[p, j]], j[reached[p, j]]
        np.subtract.at(delta, (x, j), 1)
        np.add.at(less, j, 1)
        if len(groups):
            weight = self.size[groups][:, None] * times
            g, j = near[~one], column[~one]
            p = np.minimum(np.searchsorted(groups, g), len(groups) - 1)
            p, j = p[groups[p] == g], j[groups[p] == g]
            np.subtract.at(weight, (p, j), 1)
            nearest = np.empty(weight.shape, np.int32)
            starts = _starts(by_group[0])
            for s, e, a, b in _parts(starts, len(by_group[0]), width):
                of, where = by_group[0][a:b] - s, by_group[1][a:b]
                far = dist[where]
                nearest[s:e] = np.minimum.reduceat(far, starts[s:e] - a, axis=0)
                paths = np.add.reduceat(np.where(far == nearest[s:e][of], sigma[where], 0), starts[s:e] - a, axis=0)
                weight[s:e] /= np.where(paths > 0, paths, 1)
            hit = nearest != _FAR
            weight[~hit] = 0
            ends += hit.T @ self.size[groups]
            np.add.at(less, j, hit[p, j])
            starts = _starts(by_before[1])
            for s, e, a, b in _parts(starts, len(by_before[0]), width):
                g, where = by_before[0][a:b], by_before[1][a:b]
                to = by_before[1][starts[s:e]]
                part = np.add.reduceat(np.where(nearest[g] == dist[where], weight[g], 0), starts[s:e] - a, axis=0)
                delta[to] += sigma[to] * part
        for d in range(len(levels) - 1, 0, -1):
            active = levels[d]
            on = dist[active] == d
            share = np.where(on, (times + delta[active]) / np.where(on, sigma[active], 1), 0)
            to, part = gathered(share, active, by_head[1], by_head[0])
            delta[to] += np.where(dist[to] == d - 1, sigma[to] * part, 0)
        # an inner root lies between the nodes that share its search and all that it reaches
        own = np.flatnonzero(roots < self.n)
        delta[at[roots[own]], own] = (times[own] - 1) * ends[own] - less[own]
        sums[rows] += delta.sum(axis=1)
