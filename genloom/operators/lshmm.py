"""Li and Stephens matching of haplotypes against a panel held as an ancestral graph."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np

from genloom.operators.treekernel import NULL, Graph


class MatchImpossible(ValueError):
    """No path has a likelihood above zero."""


@dataclass
class Panel:
    """What matching needs of a graph, as arrays: its edges by the sites they cover, not its trees.

    Edges are numbered twice, in the order in which they begin and in which
    they end along the sites; so the local tree is moved from site to site,
    and the size is that of the graph.
    """

    positions: np.ndarray
    length: float
    n_alleles: np.ndarray
    first: np.ndarray  # site at which each edge begins, and the one before which it ends
    last: np.ndarray
    parent: np.ndarray
    child: np.ndarray
    begins: np.ndarray  # edges by first site, edges by last site
    ends: np.ndarray
    mutated: np.ndarray  # node mutated at each site, or -1
    by_age: np.ndarray  # nodes, oldest first, then smallest id

    def nbytes(self) -> int:
        """Bytes that a broadcast of the panel takes."""
        return sum(v.nbytes for v in vars(self).values() if isinstance(v, np.ndarray))


def panel(graph: Graph, n_alleles: list[int], strict: bool = True) -> Panel:
    """The panel of a graph. At most one mutation a site is allowed while ``strict``; else the last one counts."""
    time = np.array(graph.time)
    positions = graph.sites.columns()[0]
    mutated = np.full(len(positions), NULL, np.int32)
    site, node, _, _ = graph.mutations.columns()
    if strict and len(site):
        sites, many = np.unique(site, return_counts=True)
        if (many > 1).any():
            raise ValueError(f"site {sites[many > 1][0]} has more than one mutation")
    mutated[site] = node
    left, right, parent, child = (np.array(c) for c in zip(*graph.edges)) if graph.edges else (np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    first, last = np.searchsorted(positions, left, "left"), np.searchsorted(positions, right, "left")
    some = first < last
    first, last, parent, child = first[some], last[some], parent[some].astype(np.int32), child[some].astype(np.int32)
    age = np.lexsort((np.arange(len(time)), -time))
    return Panel(positions, graph.length, np.asarray(n_alleles), first, last, parent, child, np.argsort(first, kind="stable"), np.argsort(last, kind="stable"), mutated, age)


class LocalTree:
    """The tree of one site after the other, as a parent of each node."""

    def __init__(self, p: Panel, site: int) -> None:
        self.p, self.site = p, site
        nodes = len(p.by_age)
        self.parent = np.full(nodes, NULL, np.int32)
        self.children = np.zeros(nodes, np.int32)
        self._i = int(np.searchsorted(p.first[p.begins], site, "right"))
        self._j = int(np.searchsorted(p.last[p.ends], site, "right"))
        over = np.flatnonzero((p.first <= site) & (site < p.last))
        self._put(over)
        self._live = set(np.flatnonzero((self.children > 0) | (self.parent != NULL)).tolist())

    def _put(self, edges: np.ndarray) -> None:
        self.parent[self.p.child[edges]] = self.p.parent[edges]
        np.add.at(self.children, self.p.parent[edges], 1)

    def move(self, site: int) -> bool:
        """Go on to a later site; whether the tree changes."""
        p, i, j = self.p, self._i, self._j
        while self._j < len(p.ends) and p.last[p.ends[self._j]] <= site:
            self._j += 1
        while self._i < len(p.begins) and p.first[p.begins[self._i]] <= site:
            self._i += 1
        if (i, j) == (self._i, self._j):
            self.site = site
            return False
        gone = p.ends[j : self._j]
        gone = gone[p.first[gone] <= self.site]
        self.parent[p.child[gone]] = NULL
        np.add.at(self.children, p.parent[gone], -1)
        new = p.begins[i : self._i]
        new = new[p.last[new] > site]
        self._put(new)
        for edges in (gone, new):
            for u in (*p.parent[edges].tolist(), *p.child[edges].tolist()):
                if self.children[u] > 0 or self.parent[u] != NULL:
                    self._live.add(u)
                else:
                    self._live.discard(u)
        self.site = site
        return True

    def until(self) -> int:
        """The next site at which an edge begins or ends; that after the last one if there is none."""
        p, out = self.p, len(self.p.positions)
        if self._i < len(p.begins):
            out = min(out, int(p.first[p.begins[self._i]]))
        if self._j < len(p.ends):
            out = min(out, int(p.last[p.ends[self._j]]))
        return out

    def copied(self, rank: np.ndarray) -> np.ndarray:
        """The nodes of ``inside``, in order of ``rank``; the work is that of the tree, not of the graph."""
        out = np.fromiter(self._live, np.int32, len(self._live))
        if self.children[0]:
            out = out[out != 0]
        return out[np.argsort(rank[out])]

    def inside(self) -> np.ndarray:
        """Nodes of the tree that a haplotype can copy: all but node 0 while that is above others."""
        out = (self.children > 0) | (self.parent != NULL)
        if self.children[0]:
            out[0] = False
        return out

    def below(self, node: int) -> np.ndarray:
        """Whether each node is ``node`` or below it: marks spread over twice the way in each step."""
        out = np.zeros(len(self.parent) + 1, bool)
        out[node] = True
        up = np.append(np.where(self.parent == NULL, len(self.parent), self.parent), len(self.parent))
        while True:
            wider = out | out[up]
            if (up == len(self.parent)).all() or (wider == out).all() and not out[up[up]].any():
                return wider[:-1]
            out, up = wider, up[up]


#: Bytes that the switches of all sites, kept for the way back, may take at once.
BACK_BYTES = 128 << 20
#: Sites of a stretch of the way back, at most, and bytes of its unpacked switches and of factors kept meanwhile.
STRETCH, STRETCH_BYTES, FACTOR_BYTES = 4096, 16 << 20, 16 << 20


class _Below:
    """Which columns of a local tree are a node or below it."""

    def __init__(self, tree: LocalTree, nodes: np.ndarray) -> None:
        n = len(nodes)
        self.at = {u: k for k, u in enumerate(nodes.tolist())}
        self.at.setdefault(0, n)  # above the others, but not copied
        self._n = n
        up = np.full(n + 2, n + 1, np.int64)
        up[:n] = [self.at.get(v, n + 1) for v in tree.parent[nodes].tolist()]
        self._ups = [up]
        while (self._ups[-1] <= n).any():
            self._ups.append(self._ups[-1][self._ups[-1]])

    def __call__(self, node: int) -> np.ndarray:
        out = np.zeros(self._n + 2, bool)
        if node in self.at:
            out[self.at[node]] = True
            for up in self._ups:
                out |= out[up]
        return out[: self._n]


def most_copied(p: Panel) -> int:
    """Nodes of the largest local tree, or a few more."""
    if not len(p.first):
        return 1
    moves = np.r_[p.last, p.first]
    steps = np.r_[np.full(len(p.last), -1), np.ones(len(p.first), int)]
    return int(np.cumsum(steps[np.lexsort((steps, moves))]).max()) + 1


def match(p: Panel, haplotypes: np.ndarray | list[np.ndarray], starts: np.ndarray, ends: np.ndarray, rho: np.ndarray, mu: np.ndarray, weight_by_n: bool = True, floor: float = sys.float_info.min, offsets: np.ndarray | None = None) -> list[tuple[list[tuple[float, float, int]], np.ndarray]]:
    """Best path and matched states of each haplotype (rows of codes, -1 missing) over its sites ``[start, end)``.

    Haplotypes of about one stretch advance together, as many as BACK_BYTES
    allow: one array of haplotypes by nodes of the local tree. Paths are
    ``(left, right, parent)`` from right to left. Of equally likely nodes the
    oldest wins, then the smallest id. ``rho`` and ``mu`` have a value for each
    haplotype and site. With ``offsets``, the sites that rows begin with, rows
    have the codes of a stretch that holds ``[start, end)``, and so do the states.
    """
    starts, ends = np.asarray(starts), np.asarray(ends)
    if offsets is None:
        offsets = np.zeros(len(haplotypes), int)
    each = (most_copied(p) + 7) // 8 + (2 if len(p.by_age) < 1 << 16 else 4)
    width = ends - starts
    order = np.lexsort((starts, -np.frexp(np.maximum(width, 1).astype(float))[1])) if len(width) else []
    out: list = [None] * len(haplotypes)
    lots: list[list[int]] = []
    lo = hi = own = 0
    for k in order:
        a, b = min(lo, int(starts[k])), max(hi, int(ends[k]))
        many = len(lots[-1]) + 1 if lots else 0
        if lots and many * (b - a) * each <= BACK_BYTES and many * (b - a) <= 4 * (own + int(width[k])):
            lots[-1].append(int(k))
            lo, hi, own = a, b, own + int(width[k])
        else:
            lots.append([int(k)])
            lo, hi, own = int(starts[k]), int(ends[k]), int(width[k])
    rank = np.empty(len(p.by_age), np.int64)
    rank[p.by_age] = np.arange(len(p.by_age))
    for some in lots:
        found = _matched(p, rank, [haplotypes[k] for k in some], offsets[some], starts[some], ends[some], rho[some], mu[some], weight_by_n, floor)
        for k, one in zip(some, found):
            out[k] = one
    return out


def _matched(p: Panel, rank: np.ndarray, rows: list[np.ndarray], offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rho: np.ndarray, mu: np.ndarray, weight_by_n: bool, floor: float) -> list[tuple[list[tuple[float, float, int]], np.ndarray]]:
    many, all_nodes = len(rows), len(p.by_age)
    lo, hi = int(starts.min()), int(ends.max())
    codes = np.full((hi - lo, many), -1, np.int8)
    for k, (row, at) in enumerate(zip(rows, offsets.tolist())):
        if (row >= p.n_alleles[at : at + len(row)]).any():
            raise ValueError("a haplotype has an allele that its site has not")
        a, b = max(lo, at), min(hi, at + len(row))
        codes[a - lo : b - lo, k] = row[a - at : b - at]
    n = all_nodes if weight_by_n else 1
    begin: dict[int, list[int]] = {}
    for k, s in enumerate(starts.tolist()):
        begin.setdefault(s, []).append(k)
    fixed = rho.strides[1] == 0 and mu.strides[1] == 0
    stretches: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    tree = LocalTree(p, lo)
    nodes = np.zeros(0, np.int32)
    likely = np.zeros((many, 0))
    small = np.uint16 if all_nodes < 1 << 16 else np.int32
    changed, s = True, lo
    while s < hi:
        if changed:
            old, was = nodes, likely
            nodes = tree.copied(rank)
            below = _Below(tree, nodes)
            likely = np.zeros((many, len(nodes)))
            if len(old):
                _, to, since = np.intersect1d(nodes, old, assume_unique=True, return_indices=True)
                likely[:, to] = was[:, since]
        next_change = tree.until()
        stop = min(hi, next_change, s + max(1, min(STRETCH, STRETCH_BYTES // max(1, likely.size))))
        names, which = np.unique(p.mutated[s:stop], return_inverse=True)
        table = np.array([below(u) if u != NULL else np.zeros(len(nodes), bool) for u in names.tolist()])
        moved = np.empty((stop - s, many, len(nodes)), bool)
        best = np.empty((stop - s, many), small)
        top = np.empty((many, 1))
        factors: dict[tuple, np.ndarray] = {}
        room = FACTOR_BYTES // max(1, likely.nbytes)
        alleles = p.n_alleles[s:stop].tolist()
        names_ = names.tolist()
        if fixed:
            r, m = rho[:, :1], mu[:, :1]
            stay, away = 1 - r + r / n, r / n
        for i, (w, sort) in enumerate(zip(which.tolist(), alleles)):
            at = s + i
            if at in begin:
                likely[begin[at]] = 1.0
            if not fixed:
                r, m = rho[:, at][:, None], mu[:, at][:, None]
                stay, away = 1 - r + r / n, r / n
            np.multiply(likely, stay, out=likely)
            np.less_equal(likely, away, out=moved[i])
            np.maximum(likely, away, out=likely)
            code = codes[at - lo]
            key = (w, sort, code.tobytes())
            factor = factors.get(key) if fixed else None
            if factor is None:
                right, wrong, code = 1 - (sort - 1) * m, m, code[:, None]
                fits = code <= 0 if names_[w] == NULL else (code == table[w][None, :]) | (code < 0)
                factor = np.where(fits, right, wrong)
                if fixed:
                    if len(factors) >= room:
                        factors.clear()
                    factors[key] = factor
            np.multiply(likely, factor, out=likely)
            np.argmax(likely, axis=1, out=(chosen := np.empty(many, np.intp)))
            best[i] = chosen
            np.maximum.reduce(likely, axis=1, keepdims=True, out=top)
            if not top.all():
                live = (starts <= at) & (at < ends)
                if (live & ~(top[:, 0] > 0)).any():
                    raise MatchImpossible(f"no path is possible at position {p.positions[at]:g}")
                top[top <= 0] = 1
            np.divide(likely, top, out=likely)
            np.maximum(likely, floor, out=likely)
        stretches.append((s, stop, nodes, np.packbits(moved, axis=2), best, which.astype(np.uint16), np.packbits(table, axis=1)))
        s = stop
        changed = s < hi and s == next_change and tree.move(s)
    return [_path(p, stretches, k, int(starts[k]), int(ends[k]), int(offsets[k]), len(rows[k])) for k in range(many)]


def _path(p: Panel, stretches: list[tuple], k: int, first: int, last: int, offset: int, width: int) -> tuple[list[tuple[float, float, int]], np.ndarray]:
    """Path and states of haplotype ``k``, back from its last site."""
    path: list[tuple[float, float, int]] = []
    found = np.zeros(width, np.int8)
    right = p.length if last == len(p.positions) else float(p.positions[last])
    u = None
    for begin, end, nodes, moved, best, which, table in reversed(stretches):
        a, s = max(begin, first), min(end, last) - 1
        while s >= a:
            if u is None:
                u = int(nodes[best[s - begin, k]])
            j = int(np.flatnonzero(nodes == u)[0])
            byte, bit = j >> 3, 7 - (j & 7)
            cut = np.flatnonzero((moved[a - begin : s + 1 - begin, k, byte] >> bit) & 1)
            switch = a + int(cut[-1]) if len(cut) else None
            down = a if switch is None else switch
            found[down - offset : s + 1 - offset] = (table[which[down - begin : s + 1 - begin], byte] >> bit) & 1
            if switch is not None and switch > first:
                path.append((float(p.positions[switch]), right, u))
                right = float(p.positions[switch])
                u = None
            s = down - 1
    path.append((0.0 if first == 0 else float(p.positions[first]), right, u))
    return path, found
