"""Nearest places and spanning trees in the plane, for the places of one task: memory grows with their number, and time
little faster, since places are halved along their wider side and only near halves meet."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np


def between(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt((x[:, None] - u) ** 2 + (y[:, None] - v) ** 2)


def halves(points: np.ndarray, most: int = 40) -> tuple[np.ndarray, list[list[int]]]:
    """An order of the points, and nodes (first, end, left, right) over it: the first is the whole, and nodes of more than
    ``most`` points have two halves."""
    order = np.arange(len(points))
    nodes = [[0, len(points), -1, -1]]
    for node in nodes:
        first, end = node[:2]
        if end - first > most:
            p, mid = points[order[first:end]], (end - first) // 2
            order[first:end] = order[first:end][np.argpartition(p[:, int(np.argmax(np.ptp(p, axis=0)))], mid)]
            node[2:] = len(nodes), len(nodes) + 1
            nodes += [[first, first + mid, -1, -1], [first + mid, end, -1, -1]]
    return order, nodes


def nearest(points: np.ndarray, others: np.ndarray, reach: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of points and of others, with the distances: of each point the ``most`` nearest others, as far as they are
    within its ``reach``; those beyond may be there or not."""
    (mine, blocks), (theirs, leaves) = halves(points), halves(others)
    leaves = [(a, b) for a, b, left, _ in leaves if left < 0]
    low, high = (np.array([f(others[theirs[a:b]], axis=0) for a, b in leaves]) for f in (np.min, np.max))
    at, by, far = [np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)], [np.zeros(0)]
    for a, b in ((a, b) for a, b, left, _ in blocks if left < 0):
        own = mine[a:b]
        p = points[own]
        gap = np.maximum(0, np.maximum(low - p.max(axis=0), p.min(axis=0) - high))
        met = [theirs[slice(*leaves[k])] for k in np.flatnonzero(np.sqrt((gap**2).sum(axis=1)) * (1 - 1e-12) <= reach[own].max())]
        if met:
            met = np.concatenate(met)
            d = between(p[:, 0], p[:, 1], others[met, 0], others[met, 1])
            few = np.argpartition(d, most - 1, axis=1)[:, :most] if len(met) > most else np.tile(np.arange(len(met)), (len(d), 1))
            at.append(np.repeat(own, few.shape[1]))
            by.append(met[few].ravel())
            far.append(np.take_along_axis(d, few, axis=1).ravel())
    return np.concatenate(at), np.concatenate(by), np.concatenate(far)


def _reached(n: int, at: np.ndarray, d: np.ndarray, copies: np.ndarray, least: int) -> np.ndarray:
    """The least distance up to which each of n points has ``least`` copies; infinite if there are fewer."""
    order = np.lexsort((d, at))
    at, d, upto = at[order], d[order], np.cumsum(copies[order])
    first = np.searchsorted(at, np.arange(n))
    before = np.concatenate(([0], upto))[first]
    enough = np.flatnonzero(upto - before[at] >= least)
    out = np.full(n, np.inf)
    np.minimum.at(out, at[enough], d[enough])
    return out


def cores(points: np.ndarray, copies: np.ndarray, least: int) -> np.ndarray:
    """How far each place is from the ``least``-th nearest point, itself the first, where a place is ``copies`` points;
    infinite if there are fewer."""
    order, nodes = halves(points)
    reach = np.full(len(points), np.inf)
    for own in (order[a:b] for a, b, left, _ in nodes if left < 0):
        d = between(*points[own].T, *points[own].T)
        reach[own] = _reached(len(own), np.repeat(np.arange(len(own)), len(own)), d.ravel(), np.tile(copies[own], len(own)), least)
    at, by, d = nearest(points, points, reach, least)
    return _reached(len(points), at, d, copies[by], least)


def spanning_tree(points: np.ndarray, core: np.ndarray, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and ends of the minimum spanning tree over mutual reachability, lightest edge first. Of equal weights the
    edge of the smaller names (by default the indices) goes first, so the tree doesn't depend on the order of the points.

    Edges are found as they come due: a heap holds pairs of nodes by the least weight that an edge between them can have,
    and edges by weight. Pairs whose points are all joined are passed over, others give way to pairs of their halves; two
    small nodes give their lightest edges and wait with the rest.
    """
    n = len(points)
    order, nodes = halves(points)
    x, y, c = points[order, 0], points[order, 1], core[order]
    rank = np.argsort(np.argsort(np.arange(n) if names is None else names))[order]
    name, root = rank.tolist(), list(range(n))
    joined = [False] * len(nodes)
    box = [(*(f(v[a:b]) for v in (x, y) for f in (np.min, np.max)), c[a:b].min()) for a, b, *_ in nodes] if n else []
    box = [tuple(map(float, b)) for b in box]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def whole(k: int) -> bool:
        if not joined[k]:
            first, end, left, right = nodes[k]
            top = find(first)
            if top == find(end - 1):
                joined[k] = whole(left) and whole(right) and top == find(nodes[right][0]) if left >= 0 else all(find(i) == top for i in range(first, end))
        return joined[k]

    def push(j: int, k: int) -> None:
        p, q = box[j], box[k]
        gx, gy = max(0.0, q[0] - p[1], p[0] - q[1]), max(0.0, q[2] - p[3], p[2] - q[3])
        heappush(heap, (max((gx * gx + gy * gy) ** 0.5 * (1 - 1e-12), p[4], q[4]), -1, j, k, -1.0, 0))

    heap: list[tuple] = []
    w, a, b = [], [], []
    if n:
        push(0, 0)
    while len(w) < n - 1:
        weight, low, j, k, done, other = heappop(heap)
        if low >= 0:  # an edge: low and j are its names, k and other its ends
            p, q = find(k), find(other)
            if p != q:
                root[p] = q
                w.append(weight)
                a.append(k)
                b.append(other)
            continue
        alone = whole(j), whole(k)
        if all(alone) and find(nodes[j][0]) == find(nodes[k][0]):
            continue
        (j1, j2, jl, jr), (k1, k2, kl, kr) = nodes[j], nodes[k]
        if jl >= 0 or kl >= 0:
            if j == k:
                for s, t in ((jl, jl), (jr, jr), (jl, jr)):
                    push(s, t)
            elif j2 - j1 >= k2 - k1:
                push(jl, k)
                push(jr, k)
            else:
                push(j, kl)
                push(j, kr)
            continue
        d = np.maximum(np.maximum(between(x[j1:j2], y[j1:j2], x[k1:k2], y[k1:k2]), c[j1:j2, None]), c[k1:k2])
        tops = (np.array([find(i) for i in range(*nodes[m][:2])]) for m in (j, k))
        apart = np.not_equal.outer(*tops) & (d > done)
        if j == k:
            apart = np.triu(apart)
        s, t = np.nonzero(apart)
        if not len(s):
            continue
        d, most = d[s, t], 1 if all(alone) else 2 * (j2 - j1)
        cutoff = np.partition(d, most - 1)[most - 1] if len(d) > most else d.max()
        given = d <= cutoff
        s, t, given = (s[given] + j1).tolist(), (t[given] + k1).tolist(), given.nonzero()[0]
        for weight, p, q in zip(d[given].tolist(), s, t):
            heappush(heap, (weight, min(name[p], name[q]), max(name[p], name[q]), p, weight, q))
        if len(given) < len(d) and not all(alone):
            rest = d[d > cutoff]
            heappush(heap, (float(rest.min()), -1, j, k, float(cutoff), 0))
    ends = order[np.array([a, b], dtype=int)] if w else np.zeros((2, 0), dtype=int)
    return np.array(w), ends[0], ends[1]


def rooted(n: int, a: np.ndarray, b: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a tree, each from the end that is nearer to ``first`` along the tree."""
    ends, others = np.concatenate((a, b)), np.concatenate((b, a))
    by = np.argsort(ends, kind="stable")
    starts, others = np.searchsorted(ends[by], np.arange(n + 1)).tolist(), others[by].tolist()
    parent, stack = [-1] * n, [first]
    parent[first] = first
    while stack:
        i = stack.pop()
        for k in others[starts[i] : starts[i + 1]]:
            if parent[k] < 0:
                parent[k] = i
                stack.append(k)
    up = np.array(parent)
    away = up[b] == a
    return np.where(away, a, b), np.where(away, b, a)


def lightest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of these edges, lightest first, are a spanning tree of n places."""
    root, kept = list(range(n)), []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        if i != j:
            root[i] = j
            kept.append(k)
    return np.array(kept, dtype=int)
