"""Cover trees over integer vectors and the dual-tree search for the largest inner products."""

from __future__ import annotations

import numpy as np

#: A node of so few points is not divided (data, queries); covering radii shrink by BASE from level to level.
LEAF, QUERY_LEAF, BASE = 64, 32, 1.5
#: Points of leaves that are scored at once.
CHUNK = 1024


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo .. lo + n - 1 of each pair, one after another."""
    ends = np.cumsum(n)
    return np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class Tree:
    """Nodes as arrays, level by level, children side by side: centre (a point), its norm, covering radius, first child
    and number of children; order lists the points of leaves, each leaf's from lo on.

    A node covers its points within its radius; its children's centres are separated by more than their covering radius,
    and the first child has the node's own centre.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, square = x, (x * x).sum(1)

        def distance(points: np.ndarray, c: int) -> np.ndarray:
            return np.sqrt(np.maximum(square[points] + square[c] - 2 * (x[points] @ x[c]), 0))

        nodes = [(np.arange(len(x)), 0)]
        radius, first, children, lo, size, order = [], [], [], [], [], []
        at = 0
        while at < len(nodes):
            own, c = nodes[at]
            nodes[at] = (own[:0], c)
            d = distance(own, c)
            far = float(d.max())
            radius.append(far * (1 + 1e-9) + 1e-6 * bool(far))  # rounding never makes a bound too small
            first.append(len(nodes))
            lo.append(len(order))
            size.append(0)
            if len(own) <= leaf or far == 0:
                order += own.tolist()
                size[-1] = len(own)
            else:
                rest, child = own, c
                while True:
                    near = d <= far / BASE
                    nodes.append((rest[near], child))
                    rest = rest[~near]
                    if not len(rest):
                        break
                    child = int(rest[0])
                    d = distance(rest, child)
            children.append(len(nodes) - first[-1])
            at += 1
        self.center = x[[c for _, c in nodes]]
        self.norm = np.sqrt((self.center * self.center).sum(1))
        self.radius, self.first, self.children = np.array(radius), np.array(first), np.array(children)
        self.lo, self.size, self.order = np.array(lo), np.array(size), np.array(order)

    def below(self, nodes: np.ndarray) -> np.ndarray:
        return ranges(self.first[nodes], self.children[nodes])

    def points(self, leaves: np.ndarray) -> np.ndarray:
        return self.order[ranges(self.lo[leaves], self.size[leaves])]

    def under(self, node: int) -> np.ndarray:
        """All points below a node."""
        nodes, out = np.array([node]), []
        while len(nodes):
            out.append(self.points(nodes[self.children[nodes] == 0]))
            nodes = self.below(nodes)
        return np.concatenate(out)


class Best:
    """The k best (score, id) of each query: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        least = self.score[rows, -1]
        if score.shape[1] > self.k:
            least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        some = np.unique(i)
        if not len(some):
            return
        old = np.repeat(some, self.k)
        at = np.concatenate([old, i])
        s = np.concatenate([self.score[rows[some]].ravel(), score[i, j]])
        d = np.concatenate([self.id[rows[some]].ravel(), ids[j]])
        order = np.lexsort((d, -s, at))
        at, s, d = at[order], s[order], d[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        take = first[:, None] + np.arange(self.k)
        self.score[rows[some]], self.id[rows[some]] = s[take], d[take]


def search(q: np.ndarray, q_ids: np.ndarray, r: np.ndarray, r_ids: np.ndarray, k: int) -> Best:
    """For each query the k best of r by inner product, rows of its own id left out.

    A data node is left out for a query node if no product of their points can reach the worst k-th score of the query
    node's points: <c, c'> + R' |c| + R |c'| + R R' with centres c, c' and covering radii R, R'. What a query node leaves
    out, its children need not look at.
    """
    best = Best(len(q), k)
    if not len(q) or not len(r):
        return best
    # Of equal vectors only the k + 1 smallest ids can be in a result.
    order = np.lexsort((r_ids, *r.T[::-1]))
    r, r_ids = r[order], r_ids[order]
    new = np.r_[True, (r[1:] != r[:-1]).any(1)]
    start = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    keep = np.arange(len(r)) - start <= k
    r, r_ids = r[keep], r_ids[keep]

    queries, data = Tree(q, QUERY_LEAF), Tree(r)

    def bounds(a: int, nodes: np.ndarray) -> np.ndarray:
        far, norm = queries.radius[a], queries.norm[a]
        return data.center[nodes] @ queries.center[a] + data.radius[nodes] * (norm + far) + far * data.norm[nodes]

    def sweep(a: int, rows: np.ndarray, nodes: np.ndarray) -> None:
        """A leaf of the query tree: the data leaves by falling bounds, until none can reach the worst k-th score."""
        worst, found = best.score[rows, -1].min(), []
        while len(nodes):
            nodes = nodes[bounds(a, nodes) >= worst]
            found.append(nodes[data.children[nodes] == 0])
            nodes = data.below(nodes)
        leaves = np.concatenate(found) if found else nodes
        up = bounds(a, leaves)
        order = np.argsort(-up, kind="stable")
        leaves, up = leaves[order], up[order]
        part = np.cumsum(data.size[leaves]) // CHUNK
        for chunk in np.split(np.arange(len(leaves)), np.flatnonzero(np.diff(part)) + 1):
            chunk = chunk[up[chunk] >= best.score[rows, -1].min()]
            if not len(chunk):
                break
            points = data.points(leaves[chunk])
            s = q[rows] @ r[points].T
            s[q_ids[rows][:, None] == r_ids[points][None, :]] = -np.inf
            best.offer(rows, s, r_ids[points])

    stack = [(0, np.array([0]))]
    while stack:
        a, nodes = stack.pop()
        rows = queries.under(a)
        nodes = nodes[bounds(a, nodes) >= best.score[rows, -1].min()]
        if not len(nodes):
            continue
        if not queries.children[a]:
            sweep(a, rows, nodes)
            continue
        wide = (data.radius[nodes] > queries.radius[a]) & (data.children[nodes] > 0)
        finer = np.concatenate([nodes[~wide], data.below(nodes[wide])])
        stack += [(int(child), finer) for child in queries.below(np.array([a]))]
    return best
