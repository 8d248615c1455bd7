"""What iterative operators leave on disk and move again: links are dealt once, shuffle files and used tables go."""

import os
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from tidewell.operators import graph as gr
from tidewell.session import dealt, dropped, reliable_checkpoint


def some_links(seed=5, nodes=40, links=60):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(links)]
    return [*pairs, ("n1", "n1"), ("n2", "n3"), ("n3", "n2"), ("n2", "n3")] + [("n0", f"m{k}") for k in range(25)]


def as_edges(spark, pairs):
    return spark.createDataFrame([(a, b, "X") for a, b in pairs], "src STRING, dst STRING, rel_type STRING")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        return sum(b.toString().startswith("shuffle_") for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()))

    before = files()
    table = reliable_checkpoint(spark.range(1000).repartition(3, "id"))
    assert sorted(r["id"] for r in dealt(table, "id").collect()) == list(range(1000))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    path = table.written.removeprefix("file:")
    assert os.path.isdir(path)
    dropped(table)
    assert not os.path.exists(path)


def test_a_step_of_walks_moves_no_links(spark, monkeypatch):
    plans, write = [], gr.reliable_checkpoint
    monkeypatch.setattr(gr, "reliable_checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    roots = spark.createDataFrame([(f"n{i}",) for i in range(40)], "root STRING")
    gr.random_walks(as_edges(spark, some_links()), roots, length=4, walks=2)
    assert [p.count("Exchange hashpartitioning") for p in plans[-3:]] == [1, 1, 1]


def test_walks_are_the_same_with_hubs_of_many_lists(spark, monkeypatch):
    """Lists of two, links numbered in slices of three, and the pick by definition: the n-th neighbour by hash."""
    pairs = some_links()
    edge, roots = as_edges(spark, pairs), spark.createDataFrame([("n0",), ("n1",), ("n2",), ("m3",), ("none",)], "root STRING")
    plain = rows_of(gr.random_walks(edge, roots, length=4, walks=5))
    monkeypatch.setattr(gr, "NEAR", 2)
    assert rows_of(gr.random_walks(edge, roots, length=4, walks=5)) == plain
    assert rows_of(gr.random_walks(edge, roots, length=4, walks=5, slice_rows=3)) == plain
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in {y for p in pairs for y in p}], "x STRING").select("x", F.xxhash64("x")).collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        if a != b:
            near.setdefault(b, []).append(a)
    near = {a: sorted(b, key=lambda x: (hashes[x], x)) for a, b in near.items()}
    picks = spark.createDataFrame([(r, w, s) for r in ("n0", "n1", "n2", "m3") for w in range(1, 6) for s in range(1, 4)], "root STRING, walk INT, step INT")
    pick = {(r["root"], r["walk"], r["step"]): r["h"] for r in picks.withColumn("h", F.xxhash64("root", "walk", "step", F.lit(42))).collect()}
    want = [("none", w, 0, "none") for w in range(1, 6)]
    for root in ("n0", "n1", "n2", "m3"):
        for walk in range(1, 6):
            node = root
            want.append((root, walk, 0, node))
            for step in range(1, 4):
                node = near[node][pick[(root, walk, step)] % len(near[node])]
                want.append((root, walk, step, node))
    got = [(r["root"], r["walk"], r["step"], r["node_id"]) for r in gr.random_walks(edge, roots, length=4, walks=5).collect()]
    assert sorted(got) == sorted(want)


def test_co_occurrence_in_pieces_and_with_one_exchange(spark):
    rows = [(r, w, s, f"x{random.Random(f'{r}{w}{s}').randrange(6)}") for r in ("a", "b") for w in (1, 2) for s in range(9) if (r, s) != ("b", 4)]
    walks = spark.createDataFrame(rows, "root STRING, walk INT, step INT, node_id STRING")
    at = {(r, w, s): x for r, w, s, x in rows}
    want = Counter()
    for (r, w, s), x in at.items():
        for d in (1, 2):
            if (r, w, s + d) in at:
                want[(x, at[(r, w, s + d)])] += 1
                want[(at[(r, w, s + d)], x)] += 1
    for piece in (1, 4, 100):
        assert {(r["a"], r["b"]): r["n"] for r in gr.co_occurrence(walks, piece=piece).collect()} == want
    whole = gr.co_occurrence(walks)
    whole.collect()
    plan = whole._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


def test_walk_steps_that_follow_no_link(spark):
    walks = spark.createDataFrame([("a", 1, 0, "a"), ("a", 1, 1, "b"), ("a", 1, 2, "z"), ("a", 2, 0, "a"), ("a", 2, 2, "b"), ("q", 1, 0, "q")], "root STRING, walk INT, step INT, node_id STRING")
    got = gr.walk_steps(walks, as_edges(spark, [("b", "a"), ("z", "z"), (None, "b")]))
    assert rows_of(got) == [("a", 1, 0, False), ("a", 1, 1, True), ("a", 1, 2, False), ("a", 2, 0, False), ("a", 2, 2, False), ("q", 1, 0, False)]


def reach_of(pairs, root, hops, directed=False):
    depth, front = {root: 0}, {root}
    for k in range(1, hops + 1):
        front = {y for a, b in pairs for x, y in ([(a, b)] if directed else [(a, b), (b, a)]) if x in front} - set(depth)
        depth.update({x: k for x in front})
    return {x: k for x, k in depth.items() if k}


def written_tables(monkeypatch):
    """What is written and dropped meanwhile."""
    made, gone, write, deal, drop = [], [], gr.reliable_checkpoint, gr.dealt, gr.dropped
    monkeypatch.setattr(gr, "reliable_checkpoint", lambda df: made.append(t := write(df)) or t)
    monkeypatch.setattr(gr, "dealt", lambda df, *keys, **more: made.append(t := deal(df, *keys, **more)) or t)
    monkeypatch.setattr(gr, "dropped", lambda *tables: gone.extend(tables) or drop(*tables))
    return made, gone


def test_neighbourhoods_in_parts(spark, monkeypatch):
    pairs = some_links()
    names = sorted({x for p in pairs for x in p})
    edge, roots = as_edges(spark, pairs), spark.createDataFrame([(x,) for x in [*names, "none"]], "root STRING")
    monkeypatch.setattr(gr, "PART_LINKS", 40)
    made, gone = written_tables(monkeypatch)
    for hops, directed in ((2, False), (2, True), (3, False)):
        want = sorted((r, x, k) for r in names for x, k in reach_of(pairs, r, hops, directed).items())
        got = gr.neighbourhood(edge, roots, hops, directed)
        assert rows_of(got) == want
        parts = gr.parts_for(len(pairs) * (1 if directed else 2))
        assert parts > 1 and len(made) == 2 + parts * (hops - 1) and len(gone) == 2  # links, links dealt, and a table for each part and step
        made.clear(), gone.clear()


def test_root_sets_in_parts_move_no_links(spark, monkeypatch):
    pairs = some_links()
    names = sorted({x for p in pairs for x in p} | {f"r{k}" for k in range(150)})
    edge, roots = as_edges(spark, pairs), spark.createDataFrame([(x,) for x in names], "root STRING")
    plans, write = [], gr.reliable_checkpoint
    monkeypatch.setattr(gr, "reliable_checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    want = {}
    for r in names:
        near = set(reach_of(pairs, r, 3))
        if near:
            want[r] = (len(near), sum(a in near or b in near for a, b in pairs))
    for links in (40, 10**6):
        monkeypatch.setattr(gr, "PART_LINKS", links)
        assert {r["root"]: (r["node_count"], r["rel_count"]) for r in gr.incident_counts(edge, roots, 3).collect()} == want
    # a step of the last run: the frontier to its links, and what is met and known to its node
    assert [p.count("Exchange hashpartitioning") for p in plans[-3:]] == [2, 2, 2]


def test_central_nodes_and_means_in_parts(spark, monkeypatch):
    pairs = some_links()
    names = sorted({x for p in pairs for x in p})
    edge = as_edges(spark, pairs)
    node = spark.createDataFrame([(x, "User" if x in ("n1", "n2") else "Session") for x in names if x != "n5"], "node_id STRING, label STRING")
    roots = spark.createDataFrame([("n0",), ("n1",), ("n2",), ("n7",), ("none",)], "root STRING")
    features = spark.createDataFrame([(x, d, float(len(x) * 8 + d + int(x[1:]))) for x in names if x != "n3" for d in (0, 1)], "node_id STRING, d LONG, x DOUBLE")

    def both():
        return rows_of(gr.central_nodes(edge, node, roots, 4)), sorted((r["node_id"], r["d"], round(r["x"], 9)) for r in gr.neighbour_mean(edge, features).collect())

    whole = both()
    near = {x: {x} for x in names}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    x = {r["node_id"]: r["x"] for r in features.filter("d = 0").collect()}
    means = {n: [x[y] for y in near[n] if y in x] for n in names}
    assert {(n, m) for n, d, m in whole[1] if d == 0} == {(n, round(sum(v) / len(v), 9)) for n, v in means.items() if v}
    made, gone = written_tables(monkeypatch)
    monkeypatch.setattr(gr, "PART_LINKS", 40)
    assert both() == whole
    assert len(gone) == 5 and len(made) == 5 + 2 * gr.parts_for(2 * len(pairs))


def test_components_in_parts_drop_what_is_used(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000, 1000 + k) for k in range(1, 60)]
    links = spark.createDataFrame(pairs, "a long, b long")
    monkeypatch.setattr(gr, "PART_LINKS", 200)
    made, gone = written_tables(monkeypatch)
    got = {r["v"]: r["label"] for r in gr.component_labels(links, local_links=0, block_rows=20).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    assert set(got) == set(parent)
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in parent for b in parent)
    paths = {p for t in gone for p in ([t.written] if isinstance(t.written, str) else t.written)}
    assert len(made) - len(paths) <= 1  # the labels alone are left
