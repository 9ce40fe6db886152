from folio.operators import graph as G


def _frames(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e")],
                                  "source string, target string")
    pk = spark.createDataFrame([("a", 2_000_000), ("b", 200_000), ("c", 3_000_000), ("d", 90_000_000),
                                ("e", 500_000_000)], "name string, recent_downloads bigint")
    starts = spark.createDataFrame([("a",)], "start string")
    return edges, pk, starts


def test_pruned_walk_golden(spark):
    edges, pk, starts = _frames(spark)
    walk = G.pruned_walk(edges, pk, starts)
    got = sorted((r.target, r.distance) for r in walk.collect())
    assert got == sorted([("b", 1), ("c", 1), ("a", 2), ("c", 2), ("d", 2), ("a", 3), ("c", 3), ("d", 3), ("e", 3)])
    near = sorted((r.package, r.distance) for r in G.nearest_distance(walk).collect())
    assert near == [("a", 2), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]


def test_bfs_and_separation(spark):
    edges, _pk, starts = _frames(spark)
    got = sorted((r.package, r.degree) for r in G.bfs(edges, starts, 2).collect())
    assert got == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    pairs = spark.createDataFrame([("a", "e"), ("a", "a"), ("a", "zz"), ("logger", "e")], "a string, b string")
    sep = {(r.a, r.b): r.degree for r in G.separation(edges, pairs).collect()}
    assert sep == {("a", "e"): 3, ("a", "a"): 0, ("a", "zz"): -1, ("logger", "e"): 1}


def test_separation_stops_at_the_levels_asked_for(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)] + [("x", "y")]
    edges = spark.createDataFrame(chain, "source string, target string")
    pairs = spark.createDataFrame([("n00", f"n{i:02}") for i in range(13)] + [("n05", "x"), ("y", "x"), ("eex", "n01"), ("n09", "n04")],
                                  "a string, b string")
    want = {("n00", f"n{i:02}"): i for i in range(13)} | {("n05", "x"): -1, ("y", "x"): 1, ("eex", "n01"): 1, ("n09", "n04"): 5}
    assert {(r.a, r.b): r.degree for r in G.separation(edges, pairs).collect()} == want
    near = {(r.a, r.b): r.degree for r in G.separation(edges, pairs, max_levels=3).collect()}
    assert near == {k: min(v, 4) for k, v in want.items()}


def test_bit_walks_against_brute_force(spark):
    import random

    from folio.operators import frontiers as X

    rng = random.Random(6)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(45)]
    edges = spark.createDataFrame(pairs, "source string, target string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in near:
        front, level = {s}, 0
        while front:
            want |= {(s, n): level for n in front}
            front, level = {m for n in front for m in near[n] if (s, m) not in want}, level + 1
    starts = spark.createDataFrame([(s,) for s in near], "start string")
    got = {(r.start, r.package): r.degree for r in G.bfs(edges, starts, None).collect()}
    assert got == want
    two = G.bfs(edges, starts, 2)
    assert {(r.start, r.package): r.degree for r in two.collect()} == {k: d for k, d in want.items() if d <= 2}
    lists = G.neighbours_by_degree(two, 2).collect()
    assert max(len(r.packages) for r in lists) <= 2 and sum(len(r.packages) for r in lists) == two.count()
    # The last bit of one bucket and the first of the next.
    numbers = spark.createDataFrame([("n1", 32_768), ("n2", 32_769)], "start string, number bigint")
    adj = G.undirected(edges)
    *_, last = ((k, X.starts_of(level, numbers)) for k, level in enumerate(X.walk(adj, numbers, 1)))
    assert {(r.start, r.package) for r in last[1].collect()} == {(s, n) for (s, n), d in want.items() if d == 1 and s in ("n1", "n2")}
    ask = spark.createDataFrame([(a, b) for a in near for b in near], "a string, b string")
    assert {(r.a, r.b): r.degree for r in G.separation(edges, ask).collect()} == {(a, b): want.get((a, b), -1) for a in near for b in near}


def test_walk_keeps_a_word_only_where_a_bit_is_set(spark):
    from folio.operators import frontiers as X

    edges = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(130)], "source string, target string")
    numbers = spark.createDataFrame([(f"a{i}", i + 1) for i in range(130)], "start string, number bigint")
    *_, last = X.walk(G.undirected(edges), numbers, 1, both_ways=True)
    assert dict(last.dtypes)["fresh"] == "bigint" and last.count() == 130
    assert {(r.start, r.package) for r in X.starts_of(last, numbers).collect()} == {(f"a{i}", f"b{i}") for i in range(130)}
    pairs = spark.createDataFrame([("a1", "b1", 63), ("a2", "b2", 64)], "a string, b string, number bigint")
    found = {r.number: degree for degree, met in X.meetings(G.undirected(edges), pairs) for r in X.bits_of(met, "met").collect()}
    assert found == {63: 1, 64: 1}


def test_separation_walks_within_tasks_and_without_rows_a_node(spark, monkeypatch):
    import random

    import numpy as np

    from folio.operators import ends as E

    rng = random.Random(3)
    links = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(170)] + [("n0", f"h{i}") for i in range(60)] + [("s", "s")]
    edges = spark.createDataFrame(links + [("n0", None)], "source string, target string")
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    names = sorted(near)
    pairs = [(a, names[(i * 7 + 5) % len(names)]) for i, a in enumerate(names)] + [(a, "n0") for a in names] + [("s", "s"), (None, "n0")]
    want = {}
    for a, b in pairs:
        seen, front, k = {a}, {a}, 0
        while front and b not in front:
            front, k = {y for x in front for y in near.get(x, ()) if y not in seen}, k + 1
            seen |= front
        want[a, b] = k if b in front else -1
    ask = spark.createDataFrame(pairs, "a string, b string")
    found = lambda **kw: {(r.a, r.b): r.degree for r in G.separation(edges, ask, **kw).collect()}
    near_by = {k: v if v < 3 else 3 for k, v in want.items()}
    with monkeypatch.context() as m:  # no table has a row for a pair and a node that it meets
        m.setattr(G, "meetings", None)
        assert found() == want and {k: v for k, v in found(max_levels=2).items() if want[k] >= 0} == {k: v for k, v in near_by.items() if want[k] >= 0}
    monkeypatch.setattr(G, "mounted_folder", lambda *_: None)
    assert found() == want
    # Few links at once: pairs walk on in halves, and a hub is followed in slices.
    order = {n: i for i, n in enumerate(names)}
    begin, to = [0], []
    for n in names:
        to += sorted(order[x] for x in near[n])
        begin.append(len(to))
    monkeypatch.setattr(E, "EDGES", 5)
    some = [(a, b) for a, b in want if a != b and a in order and b in order]
    got = E.walked(np.array([order[a] for a, _ in some]), np.array([order[b] for _, b in some]), np.array(begin), np.array(to))
    assert got.tolist() == [want[p] for p in some]
