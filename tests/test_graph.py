"""Graph operators against brute force on small random graphs."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewell.operators import graph as gr
from tidewell.operators import mutations as mu
from tidewell.session import dealt


def random_graph(spark, seed=5, nodes=40, edges=45):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges)]
    pairs = [(a, b) for a, b in pairs if a != b]
    node = spark.createDataFrame([(f"n{i}", "Session" if i % 2 else "User") for i in range(nodes)], "node_id STRING, label STRING")
    edge = spark.createDataFrame([(a, b, "X") for a, b in pairs], "src STRING, dst STRING, rel_type STRING")
    return node, edge, pairs, nodes


def test_components(spark):
    for seed in (1, 2):
        node, edge, pairs, n = random_graph(spark, seed)
        parent = {f"n{i}": f"n{i}" for i in range(n)}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        groups = {}
        for x in parent:
            groups.setdefault(find(x), []).append(x)
        want = {x: min(g) for g in groups.values() for x in g}
        assert {r["node_id"]: r["component"] for r in gr.connected_components(node, edge).collect()} == want


def test_long_path_component(spark):
    edge = spark.createDataFrame([(f"p{i:03d}", f"p{i + 1:03d}", "X") for i in range(150)], "src STRING, dst STRING, rel_type STRING")
    node = gr.nodes_of(edge)
    assert gr.connected_components(node, edge).select("component").distinct().collect() == [("p000",)]


def test_paths_and_neighbourhood(spark):
    node, edge, pairs, _ = random_graph(spark, 3)
    steps = [(a, b, i) for i, (a, b) in enumerate(pairs)] + [(b, a, i) for i, (a, b) in enumerate(pairs)]
    root = pairs[0][0]
    want = Counter()
    for a, b, i in steps:
        if a == root:
            want[b] += 1
            for c, d, j in steps:
                if c == b and j != i:
                    want[d] += 1
    roots = spark.createDataFrame([(root,)], "root STRING")
    assert {r["node_id"]: r["degree"] for r in gr.path_counts(edge, roots).collect()} == dict(want)
    depth, front = {root: 0}, {root}
    for k in (1, 2, 3):
        front = {b for a, b, _ in steps if a in front} - set(depth)
        depth.update({x: k for x in front})
    assert {r["node_id"]: r["depth"] for r in gr.neighbourhood(edge, roots, 3).collect()} == {k: v for k, v in depth.items() if v}


def test_erase_and_detach(spark):
    node = spark.createDataFrame([("u", "User"), ("s", "Session"), ("p", "Prediction"), ("v", "User"), ("t", "Session")], "node_id STRING, label STRING")
    edge = spark.createDataFrame([("u", "s", "HAS_SESSION"), ("s", "p", "PRODUCED"), ("v", "t", "HAS_SESSION"), ("t", "p", "PRODUCED")], "src STRING, dst STRING, rel_type STRING")
    roots = spark.createDataFrame([("u",)], "root STRING")
    nodes, edges = mu.erase(node, edge, roots)
    assert {r[0] for r in nodes.collect()} == {"v", "t"} and {r[0] for r in edges.collect()} == {"v"}
    kept, _ = mu.erase(node, edge, roots, owner=spark.createDataFrame([("u",), ("s",)], "node_id STRING"))
    assert {r[0] for r in kept.collect()} == {"p", "v", "t"}


def test_walks_follow_edges(spark):
    node, edge, pairs, _ = random_graph(spark, 9)
    roots = node.select(F.col("node_id").alias("root"))
    rows = gr.random_walks(edge, roots, length=4, walks=3).collect()
    links = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    at = {(r["root"], r["walk"], r["step"]): r["node_id"] for r in rows}
    for (root, walk, step), node_id in at.items():
        if step:
            assert (at[(root, walk, step - 1)], node_id) in links
    again = gr.random_walks(edge, roots, length=4, walks=3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_projected_vectors_have_unit_length(spark):
    node, edge, _, n = random_graph(spark, 4)
    norms = gr.projected_vectors(node, edge, dim=6, rounds=2).groupBy("node_id").agg(F.sum(F.col("x") * F.col("x")).alias("q")).collect()
    assert len(norms) == n and all(abs(r["q"] - 1) < 1e-6 for r in norms)


def test_dense_numbers(spark):
    node, edge, _, n = random_graph(spark, 6)
    assert sorted(r["idx"] for r in gr.numbered_nodes(node, slice_rows=2).collect()) == list(range(n))


def test_temporal_levels(spark):
    edge = spark.createDataFrame([("a", "b", "FOLLOWED_BY"), ("b", "c", "FOLLOWED_BY"), ("a", "c", "FOLLOWED_BY")], "src STRING, dst STRING, rel_type STRING")
    assert {r["node_id"]: r["level"] for r in gr.ancestors(edge).collect()} == {"a": 0, "b": 1, "c": 2}


def test_packed_root_sets_equal_sets(spark):
    for seed, hops in ((4, 1), (6, 3)):
        node, edge, pairs, n = random_graph(spark, seed, nodes=90, edges=100)
        roots = node.select(F.col("node_id").alias("root"))  # over one word of roots
        near = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        reach = {}
        for i in range(n):
            seen = front = {f"n{i}"}
            for _ in range(hops):
                front = {y for x in front for y in near.get(x, ())} - seen
                seen = seen | front
            reach[f"n{i}"] = seen - {f"n{i}"}
        want = {r: (len(s), sum(a in s or b in s for a, b in pairs)) for r, s in reach.items() if s}
        assert {r["root"]: (r["node_count"], r["rel_count"]) for r in gr.incident_counts(edge, roots, hops).collect()} == want
        got = sorted(tuple(r) for r in gr.labelled_within(edge, node, roots, "Session", hops).collect())
        assert got == sorted((r, x) for r, s in reach.items() for x in s if int(x[1:]) % 2)


def test_components_of_awkward_shapes_in_small_pieces(spark):
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)]
    star = [("s000", f"s{i:03d}") for i in range(1, 80)]
    ring = [(f"r{i:03d}", f"r{(i + 1) % 60:03d}") for i in range(60)]
    loops = [("l1", "l1"), ("l2", "l3"), ("l3", "l2"), ("l2", "l3")]
    edge = spark.createDataFrame([(a, b, "X") for a, b in path + star + ring + loops], "src STRING, dst STRING, rel_type STRING").repartition(4)
    node = spark.createDataFrame([("alone", "User"), ("p000", "User")], "node_id STRING, label STRING")
    got = {r["node_id"]: r["component"] for r in gr.connected_components(node, edge, local_links=10).collect()}
    want = {x: y for pairs, y in ((path, "p000"), (star, "s000"), (ring, "r000"), (loops[1:], "l2")) for p in pairs for x in p} | {"l1": "l1", "alone": "alone"}
    assert got == want
    assert gr.connected_components(node.limit(0), edge.limit(0)).count() == 0


def test_component_labels_across_blocks(spark):
    """Hubs whose links fill several blocks, repeated links, and labels against union-find."""
    rng = random.Random(4)
    pairs = [(0, k) for k in range(1, 60)] + [(100, 100 + k) for k in range(1, 40)] * 2 + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    got = {r["v"]: r["label"] for r in gr.component_labels(links, local_links=0, block_rows=5).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    assert set(got) == set(parent)
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in parent for b in parent)


def test_components_of_an_end_that_is_no_node(spark):
    node = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id STRING")
    edge = spark.createDataFrame([("a", "b"), ("x", "x")], "src STRING, dst STRING")
    assert sorted(tuple(r) for r in gr.connected_components(node, edge).collect()) == [("a", "a"), ("b", "a"), ("c", "c"), ("x", "x")]


def test_two_steps_write_no_table(spark, monkeypatch):
    def written(df):
        raise AssertionError("a table was written")

    monkeypatch.setattr(gr, "reliable_checkpoint", written)
    edge = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("a", "a")], "src STRING, dst STRING")
    roots = spark.createDataFrame([("a",), ("a",), ("z",)], "root STRING")
    assert sorted(tuple(r) for r in gr.neighbourhood(edge, roots, 2).collect()) == [("a", "b", 1), ("a", "c", 2)]


def test_local_roots():
    rng = random.Random(1)
    a, b = (np.array([rng.randrange(200) for _ in range(150)]) for _ in range(2))
    nodes, root = gr.local_roots(a, b, 3)
    of = dict(zip(nodes.tolist(), root.tolist()))
    parent = {n: n for n in of}
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        parent[x] = y

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for x in of:
        for y in of:
            assert (of[x] == of[y]) == (top(x) == top(y))


def test_trail_counts_by_hand(spark):
    """Paths of two different edges, over parallel edges as well; a self-loop counts for nothing."""
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "d"), ("e", "f")]
    got = {r["node_id"]: (r["one"], r["two"]) for r in gr.trail_counts(spark.createDataFrame(edges, "src string, dst string")).collect()}
    ends = [(x, y, i) for i, (s, d) in enumerate(edges) if s != d for x, y in ((s, d), (d, s))]
    want = {}
    for n in {x for x, _, _ in ends}:
        first = [(y, i) for x, y, i in ends if x == n]
        want[n] = (len(first), sum(1 for y, i in first for x, _, j in ends if x == y and j != i))
    assert got == want


def test_walks_are_not_broadcast(spark, monkeypatch):
    plans, write = [], gr.reliable_checkpoint
    monkeypatch.setattr(gr, "reliable_checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    _, edge, _, n = random_graph(spark, 9)
    roots = spark.createDataFrame([(f"n{i}",) for i in range(n)], "root STRING")
    walks = gr.random_walks(edge, roots, length=3, walks=2)
    assert len(plans) == 4 and not any("Broadcast" in plan for plan in plans[1:])
    assert "SortMergeJoin" in gr.co_occurrence(walks)._jdf.queryExecution().executedPlan().toString()


def test_dangling_ends_in_one_pass_over_the_edges(spark):
    node = spark.createDataFrame([("a",), ("b",), ("b",), ("é😀",), (None,)], "node_id STRING")
    rows = [("a", "b", "X"), ("a", "b", "X"), ("a", "z", "X"), ("a", "z", "X"), ("z", "a", "Y"), ("z", "y", None), (None, "a", "X"), ("a", None, "X"), ("é😀", "a", "X"), ("😀é", "a", "X")]
    edge = spark.createDataFrame(rows, "src STRING, dst STRING, rel_type STRING")
    loose = gr.dangling(edge, node)
    known = {"a", "b", "é😀"}
    assert Counter(tuple(r) for r in loose.collect()) == Counter(r for r in rows if not {r[0], r[1]} <= known)
    assert loose.columns == edge.columns
    plan = loose._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [src") == 1


def test_erasure_moves_dealt_edges_no_more(spark):
    edge = spark.range(2000).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"), F.lit("X").alias("rel_type"))
    links = dealt(edge, "src")
    assert sorted(tuple(r) for r in links.collect()) == sorted(tuple(r) for r in edge.collect())
    front = spark.createDataFrame([("7",)], "node_id STRING")
    joined = links.join(front.hint("shuffle_hash"), links["src"] == front["node_id"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(node_id" in plan
    assert [r["dst"] for r in joined.collect()] == ["8"]


def test_root_sets_with_loops_parallel_links_and_shared_numbers(spark, monkeypatch):
    rng = random.Random(11)
    pairs = [(f"n{rng.randrange(70)}", f"n{rng.randrange(70)}") for _ in range(80)] + [("n1", "n1")] * 2 + [("n2", "n3"), ("n3", "n2"), ("n2", "n3"), ("n99", "n99")]
    edge = spark.createDataFrame([(a, b, "X") for a, b in [*pairs, ("n4", None), (None, "n5")]], "src STRING, dst STRING, rel_type STRING")
    names = sorted({x for p in pairs for x in p} | {f"n{i}" for i in range(70)})
    roots = spark.createDataFrame([(x,) for x in [*names, "n1", None]], "root STRING")
    honest, seeds = gr.hashed, []

    def shared(node_id, seed):  # many ids share a number at first
        seeds.append(seed)
        return F.length(node_id).cast("long") if seed == 0 else honest(node_id, seed)

    monkeypatch.setattr(gr, "hashed", shared)
    for hops in (1, 2, 3):
        want, near = {}, {}
        for root in names:
            seen = front = {root}
            for _ in range(hops):
                front = {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in front} - seen
                seen = seen | front
            near[root] = seen - {root}
            if near[root]:
                want[root] = (len(near[root]), sum(a in near[root] or b in near[root] for a, b in pairs))
        assert {r["root"]: (r["node_count"], r["rel_count"]) for r in gr.incident_counts(edge, roots, hops).collect()} == want
        node = spark.createDataFrame([(x, "Even" if int(x[1:]) % 2 == 0 else "Odd") for x in [*names, "n500"]], "node_id STRING, label STRING")
        assert sorted(map(tuple, gr.labelled_within(edge, node, roots, "Odd", hops).collect())) == sorted((r, x) for r, s in near.items() for x in s if int(x[1:]) % 2)
    assert set(seeds) == {0, 1}
