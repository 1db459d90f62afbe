import random

from relcheck.operators import graph as H


def frames(spark, nodes, edges):
    return spark.createDataFrame([(1, n) for n in nodes], "project int, id long"), spark.createDataFrame([(1, c, p) for c, p in edges], "project int, child long, parent long")


def kahn(nodes, edges):
    left, out = {n: {p for c, p in edges if c == n and p in nodes} for n in nodes}, []
    while ready := [n for n in left if not left[n] - set(out)]:
        out.append(n := min(ready))
        del left[n]
    return out


def dag(rng):
    n = rng.randint(1, 11)
    ids = rng.sample(range(100, 100 + n), n)
    return ids, [(ids[i], ids[p]) for i in range(1, n) for p in rng.sample(range(i), rng.randint(0, min(i, 3)))]


def test_random_graphs(spark):
    # a project for each graph, so that one run covers all
    rng = random.Random(11)
    graphs = [dag(rng) for _ in range(20)]
    n = spark.createDataFrame([(k, i) for k, (ids, _) in enumerate(graphs) for i in ids], "project int, id long")
    e = spark.createDataFrame([(k, c, p) for k, (_, edges) in enumerate(graphs) for c, p in edges], "project int, child long, parent long")
    order = sorted((r["project"], r["position"], r["id"]) for r in H.deployment_order(n, e).collect())
    levels = {(r["project"], r["id"]): r["level"] for r in H.topological_levels(n, e).collect()}
    heads = {tuple(r) for r in H.heads(n, e).collect()}
    targets = spark.createDataFrame([(k, ids[-1]) for k, (ids, _) in enumerate(graphs)], "project int, id long")
    closed = {(r["project"], r["id"]) for r in H.closure(e, targets).collect()}
    for k, (nodes, edges) in enumerate(graphs):
        assert [(p, i) for q, p, i in order if q == k] == [(p + 1, i) for p, i in enumerate(kahn(nodes, edges))]
        for x in nodes:
            parents = [levels[k, p] for c, p in edges if c == x]
            assert levels[k, x] == (max(parents) + 1 if parents else 0)
        assert {i for q, i in heads if q == k} == set(nodes) - {p for _, p in edges}
        want, todo = set(), [nodes[-1]]
        while todo:
            x = todo.pop()
            if x not in want:
                want.add(x)
                todo += [p for c, p in edges if c == x]
        assert {i for q, i in closed if q == k} == want


def test_least_id_goes_next_not_level(spark):
    n, e = frames(spark, [1, 2, 5, 4], [(4, 1)])
    assert [r["id"] for r in sorted(H.deployment_order(n, e).collect(), key=lambda r: r["position"])] == [1, 2, 4, 5]


def test_cycles_and_what_is_behind_them(spark):
    n, e = frames(spark, range(1, 8), [(2, 1), (3, 4), (4, 5), (5, 3), (6, 5), (7, 1)])
    (c,) = H.cycles(n, e).collect()
    assert c["stuck"] == 4 and sorted(c["cycle"]) == [3, 4, 5] and c["cycle"][0] == 3
    assert {r["id"] for r in H.stuck_nodes(n, e).collect()} == {3, 4, 5, 6}
    assert {r["id"] for r in H.deployment_order(n, e).collect()} == {1, 2, 7}


def test_cycle_is_followed_from_the_least_stuck_node(spark):
    # 1 waits for 9, whose ring 9 -> 4 -> 7 -> 9 is entered sideways; 20 and 21 are a ring of their own
    n, e = frames(spark, [1, 4, 7, 9, 20, 21, 30], [(1, 9), (9, 4), (4, 7), (7, 9), (20, 21), (21, 20), (7, 20)])
    (c,) = H.cycles(n, e).collect()
    assert (c["stuck"], c["cycle"]) == (6, [4, 7, 9])
    n, e = frames(spark, [5, 6], [(5, 5), (6, 5)])
    (c,) = H.cycles(n, e).collect()
    assert (c["stuck"], c["cycle"]) == (2, [5])


def test_order_of_descending_chains_and_several_projects(spark):
    edges = [(1, i, i + 1) for i in range(1, 6)] + [(2, 3, 8), (2, 1, 3), (2, 2, 8), (2, 7, 2)]
    nodes = [(1, i) for i in range(1, 7)] + [(2, i) for i in (1, 2, 3, 5, 7, 8, 9)]
    n, e = spark.createDataFrame(nodes, "project int, id long"), spark.createDataFrame(edges, "project int, child long, parent long")
    got = {}
    for r in sorted(H.deployment_order(n, e).collect(), key=lambda r: (r["project"], r["position"])):
        got.setdefault(r["project"], []).append(r["id"])
    assert got == {p: kahn([i for q, i in nodes if q == p], [(c, d) for q, c, d in edges if q == p]) for p in (1, 2)}
    assert H.deployment_order(n.limit(0), e).count() == 0


def test_bad_edges(spark):
    n, e = frames(spark, [1, 2, 2], [(2, 1), (2, 1), (1, 1), (1, 9)])
    assert {(r["child"], r["parent"], r["reason"]) for r in H.invalid_edges(e).collect()} == {(2, 1, "duplicate"), (1, 1, "self")}
    assert [(r["child"], r["parent"]) for r in H.unknown_dependencies(n, e).collect()] == [(1, 9)]
    assert [(r["id"], r["n"]) for r in H.duplicate_ids(n).collect()] == [(2, 2)]
    assert H.cycles(*frames(spark, [1], [])).count() == 0


def test_long_chains_take_rounds_by_their_logarithm(spark, monkeypatch):
    # 1: ids fall along a chain, 2: they rise, 3: diamonds one below the other, 4: ids of a chain in any order
    n, rounds = 10_000, []
    monkeypatch.setattr(H, "written", lambda df, f=H.written: rounds.append(1) or f(df))
    mixed = random.Random(2).sample(range(1, 2001), 2000)
    rows = spark.range(1, n + 1)
    diamonds = [(3, 3 * i + j, 3 * i if j < 3 else 3 * i + k) for i in range(400) for j, k in ((1, 0), (2, 0), (3, 1), (3, 2))]
    nodes = rows.selectExpr("1 AS project", "id").union(rows.selectExpr("2", "id")).union(spark.range(1201).selectExpr("3", "id")).union(spark.range(1, 2001).selectExpr("4", "id"))
    edges = rows.where(f"id < {n}").selectExpr("1 AS project", "id AS child", "id + 1 AS parent").union(rows.where("id > 1").selectExpr("2", "id", "id - 1"))
    edges = edges.union(spark.createDataFrame(diamonds + [(4, c, p) for p, c in zip(mixed, mixed[1:])], "project int, child long, parent long"))
    levels = {(r["project"], r["id"]): r["level"] for r in H.topological_levels(nodes, edges).collect()}
    assert len(rounds) < 60
    assert all(levels[1, i] == n - i and levels[2, i] == i - 1 for i in range(1, n + 1))
    assert all(levels[3, 3 * i] == 2 * i for i in range(401)) and all(levels[4, x] == i for i, x in enumerate(mixed))
    chains = [x.where("project <> 3") for x in (nodes, edges)]
    rounds.clear()
    got = {(r["project"], r["id"]): r["position"] for r in H.deployment_order(*chains).collect()}
    assert len(rounds) < 160
    assert all(got[1, i] == n + 1 - i and got[2, i] == i for i in range(1, n + 1)) and all(got[4, x] == i + 1 for i, x in enumerate(mixed))
