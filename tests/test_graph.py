"""Graph algorithms against brute force."""

import itertools
import random
from fractions import Fraction

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from inquest.operators import communities as L
from inquest.operators import components as N
from inquest.operators import cycles as Y
from inquest.operators import graph as G
from inquest.operators import neighbours
from inquest.operators.neighbours import neighbour_counts


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"v{rnd.randrange(60):02d}", f"v{rnd.randrange(60):02d}") for _ in range(35)]
    edges += [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(20)]  # a chain
    edges += [("star", f"s{i}") for i in range(30)] + [("alone", "alone")]
    rnd.shuffle(edges)
    got = {r.vertex: r.component for r in N.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == brute_components(edges)


def brute_cycles(edges, max_len):
    succ = {}
    for a, b in edges:
        if a != b:
            succ.setdefault(a, set()).add(b)
    out = set()

    def walk(path):
        for n in succ.get(path[-1], ()):
            if n == path[0] and len(path) >= 2:
                out.add(tuple(path))
            elif n > path[0] and n not in path and len(path) < max_len:
                walk([*path, n])

    for a in succ:
        walk([a])
    return out


def test_cycles(spark):
    rnd = random.Random(5)
    edges = {(f"n{rnd.randrange(12):02d}", f"n{rnd.randrange(12):02d}") for _ in range(34)}
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "payer string, payee string, transfer_count int")
    got = {tuple(r.accounts) for r in Y.circular_payments(df, max_len=5).collect()}
    assert got == brute_cycles(edges, 5) and got
    few = Y.circular_payments(df, max_len=5, max_cycles=2).collect()
    assert len(few) == 2 and all(r.truncated == (len(got) > 2) for r in few)
    whole = Y.circular_payments(df, max_len=12).collect()
    assert {tuple(r.accounts) for r in whole} == brute_cycles(edges, 12) and not any(r.truncated for r in whole)
    assert len(whole) > len(got) and all(r.truncated for r in Y.circular_payments(df, max_len=3).collect())


def brute_strong(edges):
    succ = {}
    for a, b in edges:
        succ.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for n in succ.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    after = {a: reach(a) for a in succ}
    out = {a: min(b for b in after[a] if a in after.get(b, ())) for a in succ if a in after[a]}
    return {a: c for a, c in out.items() if sum(c == d for d in out.values()) > 1}


@pytest.mark.parametrize("seed", [3, 6])
def test_strong_components(spark, seed):
    """A long ring, rings with tails and bridges between them, self payments, and random edges."""
    rnd = random.Random(seed)
    edges = [(f"r{i:02d}", f"r{(i + 1) % 17:02d}") for i in range(17)]
    edges += [("m0", "m1"), ("m1", "m2"), ("m2", "m0"), ("m1", "r03"), ("a", "m0"), ("r05", "z"), ("z", "z"), ("z", "y")]
    edges += [(f"n{rnd.randrange(40):02d}", f"n{rnd.randrange(40):02d}") for _ in range(48)]
    got = {r.account: r.component for r in Y.strongly_connected(spark.createDataFrame(edges, "payer string, payee string")).collect()}
    assert got == brute_strong([(a, b) for a, b in edges if a != b])
    assert got["r16"] == "r00" and got["m2"] == "m0" and "z" not in got
    assert Y.strongly_connected(spark.createDataFrame([("a", "b"), ("b", "b")], "payer string, payee string")).count() == 0


def brute_degrees(pairs, payments, touches):
    near = {}
    for a, b in payments:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for e, a in touches:
        near.setdefault(a, set()).add(("employee", e))
    groups = {}
    for v, a in pairs:
        groups.setdefault(v, set()).add(a)
    for members in groups.values():
        for a in members:
            near.setdefault(a, set()).update(members - {a})
    return {a: len(n) for a, n in near.items() if n}


@pytest.mark.parametrize("exact_group, max_subsets", [(200, 8), (3, 8), (3, 2), (3, 0), (10_000, 8)])
def test_degrees_are_exact_for_groups_of_any_size(spark, exact_group, max_subsets):
    """One value on a third of all accounts, two more large ones that overlap it, small ones, payments inside and across."""
    rnd = random.Random(7)
    n = 900
    pairs = {("hot", i) for i in range(0, n, 3)} | {("big", i) for i in range(250)} | {("wide", i) for i in range(200, 520)}
    pairs |= {(f"v{rnd.randrange(120)}", rnd.randrange(n)) for _ in range(500)}
    payments = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(300)]
    touches = [("e1", 5), ("e1", 880), ("e2", 5)]
    df = spark.createDataFrame([(f"a{a:03d}", v) for v, a in pairs], "acc string, phone string")
    pay = spark.createDataFrame([(f"a{a:03d}", f"a{b:03d}", 1) for a, b in payments], "payer string, payee string, transfer_count int")
    touch = spark.createDataFrame([(e, f"a{a:03d}") for e, a in touches], "employee_id string, account_id string")
    spokes = G.shared_values(df, "acc", {"shared_phone": "phone"})
    got = G.account_degrees(spokes, pay, touch, exact_group=exact_group, max_subsets=max_subsets)
    assert {int(r.account[1:]): r.degree for r in got.collect()} == brute_degrees(pairs, payments, touches)


def test_neighbours_over_slices_and_blocks(spark):
    """Several slices and blocks, lists and bitmaps in one slice, partners in groups and in none."""
    rnd = random.Random(11)
    pairs = {("hot", i) for i in range(0, 400, 2)} | {(f"v{rnd.randrange(40)}", rnd.randrange(400)) for _ in range(300)}
    direct = {(rnd.randrange(450), rnd.randrange(450)) for _ in range(300)}
    direct = {(a, b) for a, b in direct | {(b, a) for a, b in direct} if a != b}
    members = spark.createDataFrame([("phone", v, f"a{a:03d}") for v, a in pairs], "kind string, value string, account string")
    ends = spark.createDataFrame([(f"a{a:03d}", f"a{b:03d}") for a, b in direct], "account string, other string")
    got = neighbour_counts(members, ends, 20, slice_rows=150, block_accounts=90)
    assert {int(r.account[1:]): r.n for r in got.collect()} == brute_degrees(pairs, direct, [])


def test_unions_are_counted_once_per_class_of_accounts_with_equal_groups(spark, monkeypatch, tmp_path):
    """Before, every account asked for the union of its own groups."""
    pairs = {(v, i) for i in range(60) for v in (f"g{i % 3}", f"h{i % 3}")} | {("g0", 59), ("solo", 0), ("solo", 3)}
    direct = [(i, j) for i, j in [(0, 1), (0, 3), (4, 70), (70, 4), (71, 70), (1, 0), (6, 2), (6, 72)]]
    members = spark.createDataFrame([("phone", v, f"a{a:03d}") for v, a in sorted(pairs)], "kind string, value string, account string")
    ends = spark.createDataFrame([(f"a{a:03d}", f"a{b:03d}") for a, b in direct], "account string, other string")
    log, plain = str(tmp_path), neighbours._counter

    def watched(list_size):
        count = plain(list_size)

        def run(table: pa.Table) -> pa.Table:
            import uuid

            asked = {r["class"] for r in table.select(["role", "class"]).to_pylist() if r["role"] == neighbours._GROUPS}
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(asked)))
            return count(table)

        return run

    monkeypatch.setattr(neighbours, "_counter", watched)
    near = {a: {b for v, x in pairs if x == a for w, b in pairs if w == v and b != a} for _, a in pairs}
    for a, b in direct:
        near.setdefault(a, set()).add(b)
    want = {a: len(x) for a, x in near.items() if x}
    got = neighbour_counts(members, ends, 5, block_accounts=7)
    assert {int(r.account[1:]): r.n for r in got.collect()} == want
    got = neighbour_counts(members, ends, 5)
    for f in tmp_path.iterdir():
        f.unlink()
    assert {int(r.account[1:]): r.n for r in got.collect()} == want
    got = neighbour_counts(members, ends, 5)
    # Three sets of groups, one more with the shared "solo", one with a group of each kind: five classes of 60 accounts.
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 5


def test_planted_communities(spark):
    edges = [(f"{g}{i}", f"{g}{j}") for g in "abc" for i, j in itertools.combinations(range(6), 2)] + [("a0", "b0"), ("b1", "c1")]
    df = spark.createDataFrame(edges, "src string, dst string")
    found = L.louvain(df).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.community_id, set()).add(r.vertex[0])
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())
    base = L._both_ways(df, "src", "dst")
    good = spark.createDataFrame([(r.vertex, r.community_id) for r in found], "v string, c string")
    whole = good.withColumn("c", F.lit("x"))
    assert L.modularity(base, good) > 0.5 > L.modularity(base, whole)
    assert all(r.settled for r in found)


def plain_louvain(edges):
    """Vertex by vertex, level by level; modularity of what comes out."""
    weight = {}
    for a, b in {tuple(sorted(e)) for e in edges if e[0] != e[1]}:
        weight[a, b] = weight[b, a] = 1.0
    total, level, member = sum(weight.values()), dict(weight), {v: v for e in weight for v in e}

    def quality(of):
        tot, inside = {}, 0.0
        for (a, b), w in weight.items():
            tot[of[a]] = tot.get(of[a], 0.0) + w
            inside += w * (of[a] == of[b])
        return inside / total - sum(x * x for x in tot.values()) / total**2

    while True:
        nodes = sorted({v for e in level for v in e})
        k = {v: sum(w for (a, _), w in level.items() if a == v) for v in nodes}
        own, tot, moved = {v: v for v in nodes}, dict(k), True
        while moved:
            moved = False
            for v in nodes:
                tot[own[v]] -= k[v]
                near = {own[v]: 0.0}
                for (a, b), w in level.items():
                    if a == v and b != v:
                        near[own[b]] = near.get(own[b], 0.0) + w
                best = max(sorted(near), key=lambda c: (round(near[c] - k[v] * tot[c] / total, 9), c == own[v]))
                moved, own[v] = moved or best != own[v], best
                tot[best] += k[v]
        merged = {v: own[c] for v, c in member.items()}
        if quality(merged) <= quality(member) + 1e-6:
            return quality(member)
        member, new = merged, {}
        for (a, b), w in level.items():
            new[own[a], own[b]] = new.get((own[a], own[b]), 0.0) + w
        level = new


@pytest.mark.parametrize("seed", [1])
def test_communities_rest_near_a_plain_run(spark, seed):
    """Planted groups with many links between them: no bound is met, and modularity is that of a plain run, or near it."""
    rnd = random.Random(seed)
    edges = [(f"{g}{rnd.randrange(12):02d}", f"{g}{rnd.randrange(12):02d}") for g in "abcde" for _ in range(40)]
    edges += [(f"{rnd.choice('abcde')}{rnd.randrange(12):02d}", f"{rnd.choice('abcde')}{rnd.randrange(12):02d}") for _ in range(30)]
    df = spark.createDataFrame(edges, "src string, dst string")
    found = L.louvain(df).collect()
    assert all(r.settled for r in found)
    base = L._both_ways(df, "src", "dst")
    got = L.modularity(base, spark.createDataFrame([(r.vertex, r.community_id) for r in found], "v string, c string"))
    assert got >= plain_louvain(edges) - 0.02


def test_communities_of_a_dense_graph_come_to_rest(spark):
    """Accounts with values drawn at random, no groups in them: moves of a fixed share swing back and forth (51 rounds before)."""
    rnd = random.Random(4)
    edges = sorted({(f"a{i:03d}", f"v{rnd.randrange(60):02d}") for i in range(300) for _ in range(30)})
    df = spark.createDataFrame(edges, "src string, dst string")
    found = L.louvain(df, max_rounds=30).collect()
    assert len(found) == len({v for e in edges for v in e}) and all(r.settled for r in found)
    base = L._both_ways(df, "src", "dst")
    got = L.modularity(base, spark.createDataFrame([(r.vertex, r.community_id) for r in found], "v string, c string"))
    assert got > 0.08  # 0.067 before
    assert all(r.community_id == min(x.vertex for x in found if x.community_id == r.community_id) for r in found)


def replayed_louvain(edges):
    """The rounds by their rule, in exact numbers: (vertex, community) pairs."""
    names = sorted({v for e in edges for v in e if e[0] != e[1]})
    first = {name: xxhash.xxh64_intdigest(name.encode(), 42) for name in names}
    again = lambda h: xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)
    links = {p for a, b in edges if a != b for p in ((a, b), (b, a))}
    level, total = {p: 1 for p in links}, len(links)

    def quality(of):
        tot = {}
        for (a, _), w in level.items():
            tot[of[a]] = tot.get(of[a], 0) + w
        return Fraction(sum(w for (a, b), w in level.items() if of[a] == of[b]), total) - Fraction(sum(x * x for x in tot.values()), total**2)

    member = {v: v for v in names}
    while True:
        nodes = sorted({v for e in level for v in e})
        k = {v: sum(w for (a, _), w in level.items() if a == v) for v in nodes}
        near = {v: {b: w for (a, b), w in level.items() if a == v != b} for v in nodes}
        c, h, moved, active = {v: v for v in nodes}, {v: first[v] for v in nodes}, set(), set(nodes)
        while True:
            tot, to, rise = {}, {}, {}
            for v in nodes:
                tot[c[v]] = tot.get(c[v], 0) + k[v]
                h[v] = again(h[v])
            for v in nodes:
                kc = {}
                for b, w in near[v].items():
                    kc[c[b]] = kc.get(c[b], 0) + w
                gain = {x: Fraction(w) - Fraction(k[v] * tot[x], total) for x, w in kc.items() if x != c[v]}
                stay = kc.get(c[v], 0) - Fraction(k[v] * (tot[c[v]] - k[v]), total)
                if gain and (v in active or any(b in moved and c[b] != c[v] for b in near[v])):
                    best = min(gain, key=lambda x: (-gain[x], x))
                    if gain[best] > stay:
                        to[v], rise[v] = best, gain[best] - stay
            if not to:
                break
            rated = []
            for n in (0, *L.SHARES):
                go = {v for v in to if n and h[v] % n == 0}
                rated.append((float(quality({v: to[v] if v in go else c[v] for v in nodes})), go))
            best, go = max(rated, key=lambda x: x[0])
            go = go or {min(to, key=lambda v: (-rise[v], v))}
            c = {v: to[v] if v in go else c[v] for v in nodes}
            moved, active = go, set(to) - go
        least = {}
        for v in nodes:
            least.setdefault(c[v], v)
        if quality(c) <= quality({v: v for v in nodes}) + Fraction(1, 10**6):
            return member
        member = {v: least[c[x]] for v, x in member.items()}
        new = {}
        for (a, b), w in level.items():
            p = least[c[a]], least[c[b]]
            new[p] = new.get(p, 0) + w
        level = new


@pytest.mark.parametrize("block, cell", [(1 << 20, 30), (14, 20)])
def test_rounds_follow_their_rule_in_cells_of_any_size(spark, block, cell):
    """Several cells, and rows whose links lie in the cells of several blocks."""
    rnd = random.Random(8)
    edges = [(f"{g}{rnd.randrange(8)}", f"{g}{rnd.randrange(8)}") for g in "abc" for _ in range(14)]
    edges += [(f"{rnd.choice('abc')}{rnd.randrange(8)}", "hub") for _ in range(12)] + [("tail", "a1"), ("x", "y"), ("z", "z")]
    df = spark.createDataFrame([*edges, (None, "a1"), edges[0], edges[0][::-1]], "src string, dst string")
    found = L.louvain(df, block=block, cell=cell).collect()
    assert {r.vertex: r.community_id for r in found} == replayed_louvain(edges) and all(r.settled for r in found)


def test_a_round_sends_no_links(spark, monkeypatch):
    """The links of a level stay where they are; before, each round shuffled them several times."""
    plans = []

    def watched(old, new, plain=L.replace_step):
        new.write.format("noop").mode("overwrite").save()
        plans.append(new._jdf.queryExecution().executedPlan().toString())
        return plain(old, new)

    monkeypatch.setattr(L, "replace_step", watched)
    rnd = random.Random(2)
    df = spark.createDataFrame([(f"a{rnd.randrange(9)}", f"v{rnd.randrange(4)}") for _ in range(30)], "src string, dst string")
    L.louvain(df, cell=10).collect()
    # The first level; later ones may be a single cell.
    lines = next(p.splitlines() for p in plans if "FlatMapCoGroupsInArrow" in p)
    below = next(i for i, x in enumerate(lines) if "FlatMapCoGroupsInArrow" in x)
    links = next(i for i, x in enumerate(lines) if "InMemoryTableScan" in x)
    assert links > below and not any("Exchange" in x for x in lines[below:links])


def test_neighbor_communities_against_pairs(spark):
    rnd = random.Random(9)
    pairs = {("phone", f"p{rnd.randrange(8)}", f"a{rnd.randrange(14):02d}") for _ in range(40)}
    comm = {f"a{i:02d}": f"c{i % 4}" for i in range(14)}
    df = spark.createDataFrame([(a, v) for _, v, a in pairs], "acc string, phone string")
    spokes = G.shared_values(df, "acc", {"shared_phone": "phone"})
    got = {r.account: r.communities_near for r in G.neighbor_communities(spokes, None, spark.createDataFrame(list(comm.items()), "account string, community_id string")).collect()}
    for a in comm:
        near = {comm[b] for _, v, x in pairs if x == a for _, w, b in pairs if w == v and b != a}
        assert got.get(a, 0) == len(near)


def test_three_hop_counts_match_the_folded_paths(spark):
    df = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("c", "d1"), ("b", "d2"), ("e", "d2")], "acc string, dev string")
    pay = spark.createDataFrame([("b", "x", 1), ("b", "y", 1), ("c", "x", 1)], "payer string, payee string, transfer_count int")
    spokes = G.shared_values(df, "acc", {"shared_device": "dev"})
    folded = G.three_hop_paths(spokes, pay).agg(F.sum("starts")).first()[0]
    counts = {r.account: r.paths for r in G.three_hop_counts(spokes, pay).collect()}
    assert counts == {"a": 3, "b": 1, "c": 2, "e": 2} and sum(counts.values()) == folded


def test_bridges_are_counted_from_spokes(spark):
    df = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("c", "d2")], "acc string, dev string")
    spokes = G.shared_values(df, "acc", {"shared_device": "dev"})
    assert G.device_bridges(spokes, G.account_degrees(spokes)).first().bridges == 1


def test_components_stop_when_all_are_stars(spark, monkeypatch):
    """No further round to see that nothing changes; chains, stars that share a leaf, loops and repeated edges come out as by hand."""
    from inquest.operators import components as N

    rounds = []
    monkeypatch.setattr(N, "replace_step", lambda *a, keep=N.replace_step: rounds.append(1) or keep(*a))
    stars = [(i, i % 5) for i in range(5, 60)] + [(7, 2), (70, 70)]
    got = {r.vertex: r.component for r in N.connected_components(spark.createDataFrame(stars, "src long, dst long")).collect()}
    assert got == {**{i: i % 5 for i in range(60)}, 70: 70} and not rounds
    chain = [(i, i + 1) for i in range(100, 140)] + [(1, 9), (2, 9), (2, 8), (None, 3)]
    got = {r.vertex: r.component for r in N.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect() if r.vertex is not None}
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 9: 1, 2: 1, 8: 1, 3: 3} and rounds
