"""The kernels on generated graphs and spans, against slow versions of the same rules."""

import tracemalloc
from functools import cache

import numpy as np
import pytest

from genloom.operators.ancestors import descriptors, make_ancestor
from genloom.operators.grouping import group_spans, levels
from genloom.operators.lshmm import LocalTree, MatchImpossible, match, panel
from genloom.operators.matching import match_codes
from genloom.operators.treekernel import COMPRESSED, Graph


def nested(seed, nodes=12, sites=30):
    """A graph in which each node copies random older ones in random stretches; some sites are mutated, each on one node."""
    rng = np.random.default_rng(seed)
    g = Graph(float(sites + 1))
    g.add_node(nodes + 2)
    g.add_node(nodes + 1)
    g.edges = [(0.0, g.length, 0, 1)]
    g.sites = [(float(k), "A") for k in range(sites)]
    for k in range(nodes):
        cuts = sorted({0, sites + 1, *rng.integers(1, sites, rng.integers(0, 4)).tolist()})
        u = g.add_node(nodes - k)
        g.edges += [(float(x), float(y), int(rng.integers(1, u)), u) for x, y in zip(cuts, cuts[1:])]
    g.mutations = [(int(s), int(rng.integers(2, nodes + 2)), "T", -1) for s in rng.permutation(sites)[: sites * 2 // 3]]
    g.sort()
    return g


def slow_match(g, codes, rho, mu):
    """The rules of matching, one node at a time: path from right to left, and the differing sites."""
    there = [s for s, c in enumerate(codes) if c >= 0] or range(len(codes))
    start, end = there[0], there[-1] + 1
    mutated = {s: u for s, u, _, _ in g.mutations}
    n, likely, back, best, states = len(g.time), None, {}, {}, {}
    for s in range(start, end):
        x = g.sites[s][0]
        parent = {c: p for a, b, p, c in g.edges if a <= x < b}
        inside = set(parent) | set(parent.values())
        if 0 in parent.values():
            inside.discard(0)

        def state(u):
            while u is not None and u != mutated.get(s):
                u = parent.get(u)
            return int(u is not None and s in mutated)

        likely = dict.fromkeys(inside, 1.0) if likely is None else {u: likely.get(u, 0.0) for u in inside}
        states[s] = {u: state(u) for u in inside}
        back[s] = set()
        for u in inside:
            stay = likely[u] * (1 - rho + rho / n)
            if not stay > rho / n:
                back[s].add(u)
            likely[u] = max(stay, rho / n) * (1 - mu if codes[s] < 0 or codes[s] == states[s][u] else mu)
        top = max(likely.values())
        best[s] = min((u for u in inside if likely[u] == top), key=lambda u: (-g.time[u], u))
        likely = {u: max(v / top, 2.2250738585072014e-308) for u, v in likely.items()}
    u, path, off = best[end - 1], [], []
    right = g.length if end == len(codes) else g.sites[end][0]
    for s in range(end - 1, start - 1, -1):
        if codes[s] >= 0 and codes[s] != states[s].get(u, 0):
            off.append((g.sites[s][0], codes[s]))
        if s > start and u in back[s]:
            path.append((g.sites[s][0], right, u))
            u, right = best[s - 1], g.sites[s][0]
    path.append((0.0 if start == 0 else g.sites[start][0], right, u))
    return path, sorted(off)


@pytest.mark.parametrize("lot_bytes", [1 << 28, 1])
def test_matching_by_slow_rules(monkeypatch, lot_bytes):
    monkeypatch.setattr("genloom.operators.lshmm.BACK_BYTES", lot_bytes)
    for seed in range(60):
        g = nested(seed)
        rng = np.random.default_rng(seed)
        copied = dict(g.genotypes(list(range(len(g.time)))))
        rows = []
        for _ in range(5):  # mosaics of two nodes, with errors and missing calls
            one, two = rng.integers(1, len(g.time), 2)
            row = [int(copied[x][one if x < 15 else two] == "T") for x, _ in g.sites]
            rows.append([-1 if r < 0.1 else 1 - c if r > 0.95 else c for c, r in zip(row, rng.random(30))])
        rows += [[-1] * 30, [-1] * 8 + rows[0][8:20] + [-1] * 10]
        got = match_codes(panel(g, [2] * 30), np.array(rows, np.int8), np.full(7, 1e-2), np.full(7, 1e-4))
        assert got == [slow_match(g, r, 1e-2, 1e-4) for r in rows]


def test_moving_tree():
    for seed in range(10):
        g = nested(seed)
        p = panel(g, [2] * 30)
        for start in (0, 11):
            tree = LocalTree(p, start)
            for s in range(start, 30, 1 + seed % 3):
                if s > start:
                    tree.move(s)
                want = {c: q for a, b, q, c in g.edges if a <= s < b}
                assert {u: q for u, q in enumerate(tree.parent.tolist()) if q != -1} == want
                for u in range(len(g.time)):
                    below = [v for v in range(len(g.time)) if u in chain(want, v)]
                    assert np.flatnonzero(tree.below(u)).tolist() == below


def chain(parent, u):
    out = [u]
    while out[-1] in parent:
        out.append(parent[out[-1]])
    return out


def star():
    g = Graph(8.0)
    for t in (2, 1, 0.6, 0.4):
        g.add_node(t)
    g.edges = [(1.0, 8.0, 0, 1), (1.0, 8.0, 1, 2), (1.0, 8.0, 1, 3)]
    g.sites = [(1.0, "A"), (3.0, "A"), (6.0, "A")]
    g.mutations = [(0, 3, "T", -1), (1, 2, "T", -1)]
    g.sort()
    return g


def test_match_errors():
    g = star()
    one = np.array([[0, 0, 1]], np.int8)
    span = (np.array([0]), np.array([3]))
    with pytest.raises(MatchImpossible):
        match(panel(g, [2, 2, 2]), one, *span, np.full((1, 3), 1e-2), np.zeros((1, 3)))
    with pytest.raises(ValueError, match="allele"):
        match(panel(g, [2, 2, 2]), one * 2, *span, np.full((1, 3), 1e-2), np.full((1, 3), 1e-20))
    ((path, _),) = match(panel(g, [3, 2, 2]), np.array([[2, 0, 0]], np.int8), *span, np.full((1, 3), 1e-2), np.full((1, 3), 1e-20))
    assert len(path) == 1
    g2 = g.copy()
    g2.mutations.append((0, 2, "T", -1))
    with pytest.raises(ValueError, match="more than one mutation"):
        panel(g2, [2, 2, 2])


def slow_groups(start, end, time):
    """Spans of one time that overlap, directly or through others, are one; its level is the longest chain of older ones it meets."""
    n = len(start)
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if time[i] == time[j] and start[i] < end[j] and start[j] < end[i]:
                    label[i] = label[j] = min(label[i], label[j])
    runs = {}
    for i in range(n):
        a, b, _ = runs.get(label[i], (start[i], end[i], time[i]))
        runs[label[i]] = (min(a, start[i]), max(b, end[i]), time[i])

    @cache
    def level(k):
        a, b, t = runs[k]
        return max((1 + level(m) for m, (c, d, u) in runs.items() if u > t and c < b and a < d), default=0)

    return [level(k) for k in label]


def test_groups_by_slow_rules():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        start = rng.integers(0, 40, 12)
        end = start + rng.integers(1, 15, 12)
        time = rng.integers(0, 4, 12)
        assert group_spans(start, end, time).tolist() == slow_groups(start.tolist(), end.tolist(), time.tolist())
    assert group_spans(np.zeros(0), np.zeros(0), np.zeros(0)).tolist() == []


def test_groups_property():
    for seed in range(100):
        rng = np.random.default_rng(seed)
        start = rng.integers(0, 200, 100)
        end = start + rng.integers(1, 100, 100)
        time = rng.integers(0, 40, 100)
        grp = group_spans(start, end, time)
        meet = (start[:, None] < end[None, :]) & (start[None, :] < end[:, None])
        same, older = time[:, None] == time[None, :], time[:, None] > time[None, :]
        assert (grp[:, None] == grp[None, :])[meet & same].all()
        assert (grp[:, None] < grp[None, :])[meet & older].all()


def test_empty_spans_are_refused():
    with pytest.raises(ValueError, match="empty"):
        levels(np.array([3]), np.array([3]), np.array([1.0]))


def bits(*rows):
    return np.array([[int(c) for c in r] for r in rows], np.int8)


def test_descriptors_break_and_order():
    calls = bits("11110000", "11000000", "10100000", "11000000", "11110000")
    assert descriptors(calls, np.array([3.0, 2, 3, 2, 3])) == [[2], [0, 4], [1], [3]]
    with pytest.raises(ValueError, match="two haplotypes"):
        descriptors(bits("1"), np.array([1.0]))


def slow_ancestor(calls, times, focal):
    """The rules, one call at a time."""
    derived = (calls == 1).sum(axis=1)
    n, age = len(calls), times[focal[0]]
    out = {f: 1 for f in focal}
    base = [h for h in range(calls.shape[1]) if calls[focal[0]][h] == 1]

    def vote(site, who):
        ones = sum(calls[site][h] == 1 for h in who)
        zeros = sum(calls[site][h] == 0 for h in who)
        return ones, zeros

    for a, b in zip(focal, focal[1:]):
        for s in range(a + 1, b):
            ones, zeros = vote(s, base)
            out[s] = 0 if times[s] <= age else -1 if ones + zeros == 0 else int(ones >= zeros)
    for begin, step in ((focal[-1], 1), (focal[0], -1)):
        who = [h for h in range(calls.shape[1]) if calls[begin][h] == 1]
        flag = dict.fromkeys(who, False)
        least, s = len(who) // 2, begin + step
        while 0 <= s < n:
            ones, zeros = vote(s, who)
            agreed = int(ones >= zeros)
            off = {h: calls[s][h] >= 0 and calls[s][h] != agreed for h in who}
            rest = [h for h in who if not (flag[h] and off[h])]
            out[s] = (-1 if ones + zeros == 0 else agreed) if times[s] > age else 0
            if times[s] > age or derived[s] > ones:
                flag.update({h: off[h] for h in rest})
            who = rest
            if len(who) <= least:
                break
            s += step
    return out


def test_ancestors_against_slow_rules():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        calls = rng.choice([-1, 0, 1], size=(12, 9), p=[0.1, 0.5, 0.4]).astype(np.int8)
        calls = calls[((calls == 1).any(axis=1)) & ((calls == 0).any(axis=1))]
        times = (calls == 1).sum(axis=1) / 9
        for focal in descriptors(calls, times):
            a, b, hap = make_ancestor(calls, times, (calls == 1).sum(axis=1), focal)
            slow = slow_ancestor(calls, times, focal)
            assert (a, b) == (min(slow), max(slow) + 1)
            assert hap.tolist() == [slow[s] for s in range(a, b)]
    with pytest.raises(ValueError, match="carriers"):
        make_ancestor(bits("00"), np.array([1.0]), np.array([0]), [0])


def test_single_site():
    calls = bits("1111")
    assert descriptors(calls, np.array([4.0])) == [[0]]
    a, b, hap = make_ancestor(calls, np.array([4.0]), np.array([4]), [0])
    assert (a, b, hap.tolist()) == (0, 1, [1])


def nodes(*rows):
    g = Graph(100.0)
    for flags, time in rows:
        g.add_node(time, flags)
    return g


def test_compression_by_slow_rules():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        g = nodes(*[(0, 5.0 + k) for k in range(3)], *[(1, float(rng.choice([0, 1, 5.0 - 2**-33]))) for _ in range(8)])
        shapes = [[(0, 100)], [(0, 50), (50, 100)]]
        for u in range(3, 11):
            g.edges += [(float(a), float(b), int(rng.integers(0, 2)), u) for a, b in shapes[rng.integers(0, 2)]]
        g.sites, g.mutations = [(5.0, "A")], [(0, 4, "T", -1)]
        paths = {u: sorted((a, b, p) for a, b, p, c in g.edges if c == u) for u in range(3, 11)}
        want_edges, want_times, moved = [], [], set()
        for path in {tuple(p): 0 for p in paths.values()}:
            kids = [u for u in paths if tuple(paths[u]) == path]
            age = min(g.time[p] for _, _, p in path) - 2**-32
            if len(kids) > 1 and age > max(g.time[u] for u in kids):
                u = 11 + len(want_times)
                want_times.append(age)
                moved |= set(kids)
                want_edges += [(a, b, p, u) for a, b, p in path] + [(a, b, u, c) for c in kids for a, b, _ in path]
        out = g.compress()
        assert out.time[11:] == want_times
        assert out.flags[11:] == [COMPRESSED] * len(want_times)
        assert sorted(out.edges) == sorted([*want_edges, *(e for e in g.edges if e[3] not in moved)])
        assert out.mutations[0][1] == 4


def test_vestigial_root_and_flanks():
    with pytest.raises(ValueError, match="nodes"):
        Graph(100.0).vestigial_root()
    odd = nodes((1, 0))
    odd.length = 1.5
    with pytest.raises(ValueError, match="whole"):
        odd.vestigial_root()
    for seed in range(10):
        g = random_graph(seed)
        out = g.vestigial_root()
        assert out.time == [max(g.time) + 1, *g.time]
        above = sorted((a, b, c) for a, b, p, c in out.edges if p == 0)
        roots = sorted((left, right, int(u) + 1) for left, right, parent in g.trees() for u in {int(p) for p in parent if p != -1} if parent[u] == -1)
        joined = []
        for a, b, u in sorted(roots, key=lambda r: (r[2], r[0])):
            if joined and joined[-1][2] == u and joined[-1][1] == a:
                joined[-1] = (joined[-1][0], b, u)
            else:
                joined.append((a, b, u))
        assert above == sorted(joined)
        assert sorted((a, b, p - 1, c - 1) for a, b, p, c in out.edges if p) == sorted(g.edges)
    assert star().erase_flanks().edges == star().edges
    h = star()
    h.intervals = [(0, 2), (5, 7)]
    assert {e[:2] for e in h.erase_flanks().edges} == {(1, 2), (5, 7)}


def random_graph(seed, leaves=6, length=40):
    """Two random trees of one genome, with a mutation on a random node at each site."""
    rng = np.random.default_rng(seed)
    g = Graph(float(length))
    for _ in range(leaves):
        g.add_node(0.0, 1)
    for left, right in ((0.0, length / 2), (length / 2, float(length))):
        live = list(range(leaves))
        while len(live) > 1:
            a, b = rng.choice(len(live), 2, replace=False)
            u = g.add_node(1 + len(g.time))
            g.edges += [(left, right, u, live[a]), (left, right, u, live[b])]
            live = [x for k, x in enumerate(live) if k not in (a, b)] + [u]
    for k, (_, _, parent) in enumerate(g.trees()):
        inside = [u for u in range(len(g.time)) if parent[u] != -1]
        for x in range(k * length // 2, (k + 1) * length // 2, 3):
            g.sites.append((float(x), "A"))
            g.mutations += [(len(g.sites) - 1, int(u), "T", -1) for u in rng.choice(inside, 1)]
    g.sort()
    return g


def test_simplify_keeps_genotypes_and_parsimony_places_them():
    for seed in range(20):
        g = random_graph(seed)
        told = dict(g.genotypes())
        s = g.simplify()
        assert dict(s.genotypes()) == {x: v for x, v in told.items() if "T" in v}
        assert s.samples() == list(range(6))
        for site, parent in g.trees_at(list(range(len(g.sites)))):
            codes = [int(a == "T") for a in told[g.sites[site][0]]]
            root, changes = g.place(parent, g.samples(), codes, 0)
            assert root == 0
            assert len(changes) <= 1
        part = g.copy()
        part.flags[3] = 0
        few = part.simplify()
        assert all(v == [told[x][u] for u in part.samples()] for x, v in few.genotypes())


def test_mutation_parents():
    for seed in range(20):
        g = nested(seed)
        rng = np.random.default_rng(seed)
        g.mutations = [(s, int(u), "TCG"[k % 3], -1) for s in range(0, 30, 4) for k, u in enumerate(rng.permutation(np.arange(1, 14))[:5])]
        g.sort()
        for site, node, _, parent in g.mutations:
            x = g.sites[site][0]
            above = chain({c: p for a, b, p, c in g.edges if a <= x < b}, node)[1:]
            mine = {u: k for k, (t, u, _, _) in enumerate(g.mutations) if t == site}
            assert parent == next((mine[u] for u in above if u in mine), -1)


def passing(sites=8_000, width=4):
    """Two nodes over all sites, and one after the other, each over a short stretch of sites and with a mutation."""
    g = Graph(float(sites + 1))
    for k in range(4):
        g.add_node(9.0 - k)
    g.edges = [(0.0, g.length, 0, 1), (0.0, g.length, 1, 2), (0.0, g.length, 1, 3)]
    for k in range(sites):
        g.sites.append((float(k), "A"))
    for a in range(0, sites, width):
        u = g.add_node(4.0)
        g.edges.append((float(a), float(min(a + width, sites)), 2, u))
        g.mutations += [(a + width // 2, u, "T", -1)]
    g.sort()
    return g


def peak(call):
    tracemalloc.start()
    try:
        out = call()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_matching_keeps_the_local_tree_only():
    """What is kept for the way back grows with the nodes of one site's tree, not with all that the graph has."""
    g = passing()
    p = panel(g, [2] * len(g.sites))
    rows = np.zeros((4, len(g.sites)), np.int8)
    rows[1::2, 2::4] = 1
    found, mb = peak(lambda: match_codes(p, rows, np.full(4, 1e-2), np.full(4, 1e-20)))
    assert mb < 6
    assert found[0] == ([(0.0, g.length, 1)], [])
    assert {u for _, _, u in found[1][0]} >= set(range(4, 2004)) and found[1][1] == []
    assert found[0] == found[2] and found[1] == found[3]


def test_sites_and_mutations_are_columns():
    """A graph takes a few bytes for each site, sorted and decoded too; its tables still are lists of tuples."""

    def run():
        g = Graph(200_000.0)
        g.add_node(1.0)
        g.add_node(0.0, 1)
        g.edges = [(0.0, g.length, 0, 1)]
        for k in range(100_000):
            g.sites.append((float(k), "A"))
            g.mutations.append((k, k % 2, "TC"[k % 2], -1))
        g.sort()
        return g, sum(alleles == ["TC"[int(x) % 2]] for x, alleles in g.genotypes())

    (g, right), mb = peak(run)
    assert mb < 30 and right == 100_000
    assert g.sites[-1] == (99_999.0, "A") and g.mutations[1:3] == [(1, 1, "C", -1), (2, 0, "T", -1)]
    assert g.sites == list(g.sites) and g.sites != list(g.sites)[1:] and g.copy().mutations == g.mutations
