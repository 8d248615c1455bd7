"""Property-graph operators on ``node(node_id, label)`` and ``edge(src, dst, rel_type)`` tables.

Traversals are loops of equi-joins over the whole graph: every root advances in the same job.
Frontiers are made distinct (or counted) each step, so a hub is visited once per root and step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewell.operators.ordered import SLICE_ROWS, sequenced
from tidewell.operators.timelines import latest_per
from tidewell.schemas import GRAPH_EMOTIONS, GRAPH_SYMPTOMS, TEMPORAL_EDGES
from tidewell.session import dealt, dropped, reliable_checkpoint


def symmetric(edge: DataFrame) -> DataFrame:
    """Both directions of every edge; a self-loop appears once."""
    back = edge.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edge.columns if c not in ("src", "dst")])
    return edge.unionByName(back)


#: Links, both ways, up to which the work is one plan; beyond, it is done in parts, so that shuffle files of one part at a time lie on disk.
PART_LINKS = 150_000_000


def parts_for(links: int) -> int:
    return max(1, -(-links // PART_LINKS))


def in_part(name: str, parts: int, part: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(parts)) == part


def by_parts(parts: int, made: Callable[[int], DataFrame]) -> DataFrame:
    """The rows of all parts together; if there are several, each is written before the next one starts."""
    return made(0) if parts == 1 else written_by_parts(parts, made)


def written_by_parts(parts: int, made: Callable[[int], DataFrame]) -> DataFrame:
    tables = [reliable_checkpoint(made(part)) for part in range(parts)]
    rows = reduce(DataFrame.unionByName, tables)
    rows.written = [table.written for table in tables]
    return rows


def neighbourhood(
    edge: DataFrame, roots: DataFrame, hops: int = 2, directed: bool = False, max_hops: int | None = 3
) -> DataFrame:
    """Nodes within ``hops`` of each root with their distance (GR1 to GR5).

    ``roots`` has ``root``. A root itself is not listed. Links are dealt by source once, whatever the hops, as
    all steps join with the same exchange. A step's frontier is made distinct with the depth it is first met at; the
    last step goes straight into the result. Beyond ``PART_LINKS`` links these are written in buckets, and the roots follow
    part by part, as their rows are many times their number.
    """
    if max_hops is not None and hops > max_hops:
        raise ValueError(f"at most {max_hops} hops")

    def both(rows: DataFrame) -> DataFrame:
        return (rows.select("src", "dst") if directed else rows.select(F.expr("stack(2, src, dst, dst, src) AS (src, dst)"))).filter("src <> dst")

    roots = roots.select("root").distinct()
    parts = parts_for(edge.count() * (1 if directed else 2))
    if parts == 1:
        return _within(both(edge).repartition("src").distinct(), roots, hops)
    written = reliable_checkpoint(edge.select("src", "dst"))
    links = dealt(both(written).repartition("src").distinct(), "src", moved=True, parts=parts)
    dropped(written)
    reach = by_parts(parts, lambda part: _within(links, roots.filter(in_part("root", parts, part)), hops, "shuffle_hash"))
    dropped(links)
    return reach


def _within(links: DataFrame, roots: DataFrame, hops: int, *hint: str) -> DataFrame:
    """``hint``: how frontiers are joined with links in buckets, which need not be sorted then."""
    def hinted(rows: DataFrame) -> DataFrame:
        return rows.hint(*hint) if hint else rows

    # from the root alone, over distinct links, each node is met once
    seen = hinted(roots).join(links, roots["root"] == links["src"]).select("root", F.col("dst").alias("node_id"), F.lit(1).cast("long").alias("depth"))
    for step in range(2, hops + 1):
        frontier = seen.filter(F.col("depth") == step - 1)
        met = hinted(frontier).join(links, frontier["node_id"] == links["src"]).select("root", F.col("dst").alias("node_id"), F.lit(step).cast("long").alias("depth"))
        seen = seen.unionByName(met.filter("node_id <> root")).groupBy("root", "node_id").agg(F.min("depth").alias("depth"))
        if step < hops:
            seen = reliable_checkpoint(seen)
    return seen


def limited(reach: DataFrame, n: int | None = 500) -> DataFrame:
    """The interactive cut: the nearest ``n`` nodes of each root, by depth then id."""
    if n is None:
        return reach
    return latest_per(reach, ["root"], [F.col("depth"), F.col("node_id")], n).drop("rank")


def guarded(reach: DataFrame, max_nodes: int = 500) -> DataFrame:
    """Fails when a root reaches more than ``max_nodes`` nodes (GR5)."""
    sizes = reach.groupBy("root").agg(F.count("*").alias("_n"))
    checked = sizes.withColumn("_ok", F.when(F.col("_n") > max_nodes, F.raise_error(F.lit("subgraph too large"))).otherwise(F.lit(True)))
    return reach.join(checked.filter("_ok").select("root"), "root")


#: Roots whose flags share one number.
WORD = 64


def numbered(node_ids: DataFrame) -> DataFrame:
    """``node_id, _n``: a written table of distinct ids with a number each, in no order."""
    return reliable_checkpoint(node_ids.distinct().withColumn("_n", F.monotonically_increasing_id()))


def hashed(node_id: Column, seed: int) -> Column:
    """A number of a node by its id; another ``seed`` gives other numbers."""
    return F.xxhash64(F.lit(seed), node_id)


class RootSets:
    """Which roots reach a node, for very many roots: one row per node and word of roots, not per node and root.

    Roots are numbered, ``WORD`` of them to a word, a bit each; a root's own node is no part of its reach, as in ``neighbourhood``. A step sends words along links and
    merges them with what is known by ``bit_or``, before and after one shuffle, so a hub that all users reach costs a row per word.

    Links are dealt by one end once, so a step moves words alone. Beyond ``PART_LINKS`` links the roots follow part by part.
    Nodes are numbered by a hash of their id, so links need no join to get numbers. A second hash tells ids that share
    a number, and then the next seed is taken. ``nodes`` has further ids (``node_id``) whose numbers must be their own.
    Links with a null end and null roots are left out.
    """

    def __init__(self, edge: DataFrame, roots: DataFrame, hops: int, nodes: DataFrame | None = None) -> None:
        edge = edge.filter("src IS NOT NULL AND dst IS NOT NULL")
        roots = roots.select("root").filter("root IS NOT NULL").distinct()
        self.seed, self.hops = 0, hops
        while not self._number(edge, roots, nodes):
            self.seed += 1
        asked = reliable_checkpoint(roots.select("root", self.number("root").alias("_n"), F.monotonically_increasing_id().alias("_i")))
        bit = F.pmod("_i", F.lit(WORD)).cast("int")
        self.roots = asked.select("root", "_n", F.shiftright("_i", 6).alias("word"), bit.alias("bit"))

    def _spread(self, part: int) -> DataFrame:
        """``_n, word, own, seen, bits``: the roots of a node itself, all that have it within reach, those that have it at the last step."""
        flag, none = F.expr("shiftleft(1L, bit)"), F.lit(0).cast("long")
        # own: bits of the node itself as a root, seen: of all roots that have reached it, bits: of those new in the last step
        roots = self.roots.filter(F.pmod("word", F.lit(self.parts)) == part)
        known, links = roots.select("_n", "word", flag.alias("own"), flag.alias("seen"), flag.alias("bits")), self.links
        for step in range(self.hops):
            frontier = known.filter("bits <> 0")
            met = frontier.hint("shuffle_hash").join(links, frontier["_n"] == links["at"]).select(F.col("to").alias("_n"), "word", none.alias("own"), none.alias("seen"), "bits")
            merged = known.withColumn("bits", none).unionByName(met).groupBy("_n", "word").agg(*[F.bit_or(c).alias(c) for c in ("own", "seen", "bits")])
            before, known = known, reliable_checkpoint(merged.select("_n", "word", "own", F.expr("seen | bits AS seen"), F.expr("bits & ~seen AS bits")))
            if step:
                dropped(before)
        return known

    def answered(self, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``made`` makes of ``_n, word, own, seen, bits``, for all roots, part by part if there are many links."""
        def of(part: int) -> DataFrame:
            known = self._spread(part)
            rows = made(known)
            if self.parts > 1:
                rows = reliable_checkpoint(rows)
                dropped(known)
            return rows

        return reduce(DataFrame.unionByName, [of(part) for part in range(self.parts)])

    def _number(self, edge: DataFrame, roots: DataFrame, nodes: DataFrame | None) -> bool:
        """Deals ``links`` (``at, to, out``: both ways, parallel ones too) and ``incoming`` (``_n, d, e``: links into a node, those from others); whether all ids have numbers of their own."""
        ends = [number(c).alias(c[0] + str(k)) for c in ("src", "dst") for k, number in enumerate((self.number, self.other))]
        written = reliable_checkpoint(edge.select(*ends))
        self.parts = parts_for(2 * written.count())
        ids = written.selectExpr("stack(2, s0, s1, 0L, 0L, d0, d1, 1L, IF(s0 = d0, 0L, 1L)) AS (_n, other, d, e)")
        for more, name in ((roots, "root"), (nodes, "node_id")):
            if more is not None:
                ids = ids.unionAll(more.select(self.number(name), self.other(name), F.lit(0).cast("long"), F.lit(0).cast("long")))
        counted = ids.groupBy("_n").agg(F.sum("d").alias("d"), F.sum("e").alias("e"), (F.min("other") != F.max("other")).alias("shared"))
        self.incoming = dealt(counted, "_n", moved=True, parts=self.parts)
        own = self.incoming.filter("shared").isEmpty()
        if own:
            ways = F.array(F.struct(F.col("s0").alias("at"), F.col("d0").alias("to"), F.lit(True).alias("out")), F.struct(F.col("d0").alias("at"), F.col("s0").alias("to"), F.lit(False).alias("out")))
            self.links = dealt(written.select(F.explode(ways).alias("l")).select("l.*"), "at", parts=self.parts)
        dropped(written, *([] if own else [self.incoming]))
        return own

    def number(self, name: str) -> Column:
        return hashed(F.col(name), self.seed)

    def other(self, name: str) -> Column:
        return F.hash(F.lit(self.seed), F.col(name))

    @staticmethod
    def by_bit(rows: DataFrame) -> DataFrame:
        """A row with ``bit`` for each bit that is set; a word with one bit, as most in a sparse graph, is one row at once."""
        places = F.when(F.bit_count("bits") == 1, F.array(F.length(F.bin("bits")) - 1)).otherwise(F.sequence(F.lit(0), F.lit(WORD - 1)))
        return rows.withColumn("bit", F.explode(places)).filter("getbit(bits, bit) = 1").drop("bits")

    def totals(self, rows: DataFrame, *names: str) -> DataFrame:
        """``root`` and ``names``: per root the sums of these columns over the rows (``word, bits``) that hold its bit.

        Added up before they move; roots without a row have no totals.
        """
        per_root = self.by_bit(rows).groupBy("word", "bit").agg(*[F.sum(c).alias(c) for c in names])
        return self.roots.join(per_root, ["word", "bit"]).select("root", *names)

    def pairs(self, rows: DataFrame) -> DataFrame:
        """``root`` and the other columns of ``rows``, one row for each bit that is set."""
        return self.by_bit(rows).join(self.roots.select("root", "word", "bit"), ["word", "bit"]).drop("word", "bit")


def labelled_within(edge: DataFrame, node: DataFrame, roots: DataFrame, label: str, hops: int = 2) -> DataFrame:
    """Distinct nodes of one label within reach (GR3). Only the pairs of the result are written out."""
    wanted = node.filter(F.col("label") == label).filter("node_id IS NOT NULL").select("node_id").distinct()
    sets = RootSets(edge, roots, hops, wanted)
    wanted = wanted.select("node_id", sets.number("node_id").alias("_n"))
    reach = F.expr("seen & ~own AS bits")
    return sets.answered(lambda known: sets.pairs(known.select("_n", "word", reach).filter("bits <> 0").join(wanted, "_n").drop("_n")).select("root", "node_id"))


def link_counts(edge: DataFrame) -> DataFrame:
    """``src, dst, m``: parallel links counted, both ways, dealt by ``src``."""
    return symmetric(edge.select("src", "dst")).repartition("src").groupBy("src", "dst").agg(F.count("*").alias("m"))


def path_counts(edge: DataFrame, roots: DataFrame) -> DataFrame:
    """Number of 1- and 2-step paths from each root to each node, no edge used twice (GR9).

    Paths are counted, not listed: 2-step counts come from per-pair edge counts, which are made where they are joined.
    """
    return _paths(link_counts(edge), roots)


def _paths(pair: DataFrame, roots: DataFrame, *hint: str) -> DataFrame:
    def hinted(rows: DataFrame) -> DataFrame:
        return rows.hint(*hint) if hint else rows

    one = hinted(roots).join(pair, roots["root"] == pair["src"]).select("root", F.col("dst").alias("node_id"), "m")
    nxt = pair.select(F.col("src").alias("mid"), F.col("dst").alias("node_id"), F.col("m").alias("m2"))
    two = hinted(one.select("root", F.col("node_id").alias("mid"), "m")).join(nxt, "mid")
    # going back to the root must not reuse the edge walked first
    again = F.when(F.col("node_id") == F.col("root"), F.col("m") * (F.col("m2") - 1)).otherwise(F.col("m") * F.col("m2"))
    two = two.select("root", "node_id", again.alias("m"))
    return one.unionByName(two).groupBy("root", "node_id").agg(F.sum("m").alias("degree")).filter("degree > 0")


def central_nodes(edge: DataFrame, node: DataFrame, roots: DataFrame, n: int = 10) -> DataFrame:
    """Top nodes by path count around each root, users left out (GR9).

    Beyond ``PART_LINKS`` links, counted links and labels are written in buckets and the roots follow part by part.
    """
    written = reliable_checkpoint(edge.select("src", "dst"))
    parts = parts_for(2 * written.count())
    labels = node.select("node_id", "label").filter("label <> 'User'").repartition("node_id").distinct()
    pair = link_counts(written)
    if parts > 1:
        labels, pair = (dealt(x, key, moved=True, parts=parts) for x, key in ((labels, "node_id"), (pair, "src")))
        dropped(written)
    hint = ["shuffle_hash"] if parts > 1 else []

    def top(part: int) -> DataFrame:
        paths = _paths(pair, roots.filter(in_part("root", parts, part)) if parts > 1 else roots, *hint)
        return latest_per(paths.join(labels, "node_id"), ["root"], [F.desc("degree"), F.col("node_id")], n)

    best = by_parts(parts, top)
    if parts > 1:
        dropped(labels, pair)
    return best


def incident_counts(edge: DataFrame, roots: DataFrame, hops: int = 3) -> DataFrame:
    """Nodes within reach and edges touching them (GR8).

    An edge into a reached node counts there, an edge into the root too, unless it is a loop, as it comes from
    its neighbour. Any other edge leaves the ball, so it starts from a node of the last step. All are sums over words of roots.
    """
    sets = RootSets(edge, roots, hops)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def counts(known: DataFrame) -> DataFrame:
        into = known.join(sets.incoming, "_n").withColumn("at", F.explode(F.array(
            F.struct(F.expr("seen & ~own").alias("bits"), one.alias("node_count"), F.col("d").alias("rel_count")), F.struct(F.col("own").alias("bits"), none.alias("node_count"), F.col("e").alias("rel_count")))))
        last = known.filter("bits <> 0").select("_n", "word", "bits")
        out = last.hint("shuffle_hash").join(sets.links.filter("out"), last["_n"] == F.col("at")).select(F.col("to").alias("b"), "word", "bits")
        out = out.join(known.select(F.col("_n").alias("b"), "word", "seen"), ["b", "word"], "left").select("word", F.expr("bits & ~coalesce(seen, 0L) AS bits"), none.alias("node_count"), one.alias("rel_count"))
        rows = into.select("word", "at.*").unionByName(out).filter("bits <> 0")
        return sets.totals(rows, "node_count", "rel_count").filter("node_count > 0")

    return sets.answered(counts)


def degrees(edge: DataFrame) -> DataFrame:
    """Undirected degree; isolated nodes are absent (GR10)."""
    ends = edge.select(F.col("src").alias("node_id")).unionAll(edge.select(F.col("dst").alias("node_id")))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def trail_counts(edge: DataFrame) -> DataFrame:
    """Number of undirected paths of one and of two different edges from each node (JN19).

    Paths are counted, not listed: each edge to a neighbour goes on over all the neighbour's other edges,
    parallel ones and those back to the start included. Self-loops are left out.
    """
    links = edge.filter("src <> dst")
    degree = degrees(links)
    ends = links.select(F.col("src").alias("start"), F.col("dst").alias("node_id")).unionAll(links.select(F.col("dst").alias("start"), F.col("src").alias("node_id")))
    return ends.join(degree, "node_id").groupBy(F.col("start").alias("node_id")).agg(F.count("*").alias("one"), F.sum(F.col("degree") - 1).alias("two"))


def reachable(edge: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes that can be reached from any root over outgoing edges, roots included: ``node_id`` (MUT9).

    One distinct set for all roots; each step visits only nodes not met before and the loop ends when
    there are none, so depth and cycles need no bound. The edges are read once a step: pass a table ``dealt``
    by ``src``, so that only the frontier moves; it is hashed, as the larger side would have to be sorted otherwise.
    """
    links = edge.select("src", "dst")
    frontier = reached = reliable_checkpoint(roots.select(F.col("root").alias("node_id")).distinct())
    step = 0
    while not frontier.isEmpty():
        onward = links.join(frontier.hint("shuffle_hash"), links["src"] == frontier["node_id"]).select(F.col("dst").alias("node_id")).distinct()
        frontier = reliable_checkpoint(onward.join(reached, "node_id", "left_anti"))
        reached = reached.unionByName(frontier)
        step += 1
        if step % 8 == 0:
            reached = reliable_checkpoint(reached)  # few files, however deep the graph
    return reached


#: Links that a task joins at a time; when no more are left, one task does.
LOCAL_LINKS = 250_000


def local_roots(a: np.ndarray, b: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links ``a, b`` and the root of its component among them, chosen by hash."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    key = (nodes.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key ^ (key >> np.uint64(29)), kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    u, v = rank[at[: len(a)]], rank[at[len(a) :]]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            return nodes, nodes[order][root[rank]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _locally(seed: int, most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield joined(held)
                held, size = [], 0
        if size:
            yield joined(held)

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([batch.column(k).to_numpy() for batch in held]) for k in (0, 1))
        nodes, root = local_roots(a, b, seed)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["v", "root"])

    return run


#: Rows that a task holds at a time while it goes along sorted links.
BLOCK_ROWS = 1_000_000
#: Nodes with at most this many neighbours join one of them in the first round, whatever its order.
FEW = 2


def _blocks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """The columns of the batches as arrays of at least ``most`` rows, the last ones as they are."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            yield [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(held[0].num_columns)]
            held, size = [], 0
    if size:
        yield [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(held[0].num_columns)]


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs without those equal to the one before."""
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def _picks(mask: int, few: int, most: int):
    """Links ``v, u`` in both directions, sorted by ``v``, to ``v, pick, own``: what ``v`` joins, and that sent to its neighbours.

    ``v`` joins the least of itself and its neighbours in an order that ``mask`` changes, or, with at most ``few``
    neighbours, the least of these. A node whose links cross a block keeps the choice of the first block.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for v, u in _blocks(batches, most):
            if not few:  # links given by the round before may be repeated
                order = np.lexsort((u, v))
                v, u = _once(v[order], u[order])
            starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            count = np.diff(np.append(starts, len(v)))
            head, best = v[starts], np.minimum.reduceat(u ^ mask, starts)
            pick = np.where(count <= few, best, np.minimum(best, head ^ mask)) ^ mask
            old = int(last is not None and last[0] == head[0])
            if old:
                pick[0] = last[1]
            last = head[-1], pick[-1]
            once = v < u
            to = np.concatenate((head[old:], u[once]))
            own = np.arange(len(to)) < len(head) - old
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.concatenate((pick[old:], np.repeat(pick, count)[once]))), pa.array(own)], ["v", "pick", "own"])

    return run


def _meetings(most: int):
    """Picks sorted by ``v``, its own first, to ``a, b, own``: (node, pick) and the links between different picks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty(0, np.int64)
        for v, pick, own in _blocks(batches, most):
            mine = np.concatenate((last, pick[own]))  # the first rows may belong to the last node of the block before
            here = mine[np.cumsum(own) + len(last) - 1]
            last = mine[-1:]
            led = ~own & (here != pick)
            low, high = np.minimum(here, pick)[led], np.maximum(here, pick)[led]
            order = np.argsort(low * 3 ^ high)
            low, high = _once(low[order], high[order])
            a, b = np.concatenate((v[own], low)), np.concatenate((pick[own], high))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) < own.sum())], ["a", "b", "own"])

    return run


def component_labels(links: DataFrame, local_links: int = LOCAL_LINKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``v, label``: one node of its component for every node of the links ``a, b`` (numbers).

    In a round each node joins the least of itself and its neighbours in an order that changes with the round; nodes
    with few neighbours join one of these in the first round, as that ends leaves and the inner nodes of chains at once. A link then
    leads from pick to pick, wherever these have gone themselves: what was connected stays so, and nothing else gets connected. Nodes are
    at least about halved by a round. Links move by one end, sorted, in both directions, then once to the other end, beyond ``PART_LINKS``
    part by part of the nodes; what is used up is dropped. When
    ``local_links`` are left, one task joins them by union-find. The picks of the rounds are then followed back.
    """
    rounds: list[tuple[DataFrame, DataFrame]] = []  # what a round has written, and the picks in it
    links = given = reliable_checkpoint(links)
    count = links.count()
    while True:
        step, parts = len(rounds), parts_for(2 * count)
        mask = (0x9E3779B97F4A7C15 * step) % 2**63
        both = links.select(F.expr("stack(2, a, b, b, a) AS (v, u)"))

        def picked(part: int, both: DataFrame = both, mask: int = mask, few: int = 0 if rounds else FEW, parts: int = parts) -> DataFrame:
            rows = both.filter(in_part("v", parts, part)) if parts > 1 else both
            return rows.repartition("v").sortWithinPartitions("v").mapInArrow(_picks(mask, few, block_rows), "v long, pick long, own boolean")

        picks, seen = by_parts(parts, picked), [Observation() for _ in range(parts)]

        def meeting(part: int, picks: DataFrame = picks, seen: list[Observation] = seen, parts: int = parts) -> DataFrame:
            rows = picks.filter(in_part("v", parts, part)) if parts > 1 else picks
            met = rows.repartition("v").sortWithinPartitions("v", F.desc("own")).mapInArrow(_meetings(block_rows), "a long, b long, own boolean")
            return met.observe(seen[part], F.count_if("own").alias("nodes"), F.count_if(~F.col("own")).alias("links"))

        met = written_by_parts(parts, meeting)
        if parts > 1:
            dropped(picks)
        if not step:
            dropped(given)
        nodes, count = (sum(x.get[name] for x in seen) for name in ("nodes", "links"))
        if not nodes:
            return met.select(F.col("a").alias("v"), F.col("b").alias("label"))
        rounds.append((met, met.filter("own").select(F.col("a").alias("v"), F.col("b").alias("label"))))
        if not count:
            break
        links = met.filter("NOT own").select("a", "b")
        if count <= local_links:
            last = reliable_checkpoint(links.coalesce(1).mapInArrow(_locally(step + 1, local_links + 1), "v long, label long"))
            rounds.append((last, last))
            break
    written, labels = rounds.pop()
    for met, earlier in reversed(rounds):
        up = labels.select(F.col("v").alias("pick"), F.col("label").alias("_up"))
        labels = reliable_checkpoint(earlier.withColumnRenamed("label", "pick").join(up, "pick", "left").select("v", F.coalesce("_up", "pick").alias("label")))
        dropped(met, written)
        written = labels
    return labels


def connected_components(node: DataFrame, edge: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """Smallest node id of each node's component (GR11).

    Ids are numbered by a hash, so links need no join to get numbers. When two node ids share a hash, or an end of a link
    is no node, nodes are numbered by a table of all ids and links joined with it instead.
    """
    hashed = edge.select(F.xxhash64(F.coalesce("src", "dst")).alias("a"), F.xxhash64(F.coalesce("dst", "src")).alias("b"))  # self-loops too, for their nodes
    labels = component_labels(hashed, local_links)
    ids = node.select(F.xxhash64("node_id").alias("v"), "node_id").repartition("v").groupBy("v").agg(F.min("node_id").alias("node_id"), F.max("node_id").alias("_other"))
    seen = Observation()
    rooted = ids.join(labels, "v", "full").select("node_id", "_other", F.coalesce("label", "v").alias("_root"))
    rooted = rooted.observe(seen, F.count_if(~F.col("node_id").eqNullSafe(F.col("_other")) | F.col("node_id").isNull()).alias("unsure"))
    rooted = reliable_checkpoint(rooted.drop("_other"))
    if seen.get["unsure"]:
        numbers = numbered(node.select("node_id").union(edge.select("src")).union(edge.select("dst")))
        links = edge.filter("src <> dst").join(numbers.toDF("dst", "b"), "dst").join(numbers.toDF("src", "a"), "src").select("a", "b")
        labels = component_labels(links, local_links).withColumnRenamed("v", "_n")
        rooted = reliable_checkpoint(numbers.join(labels, "_n", "left").select("node_id", F.coalesce("label", "_n").alias("_root")))
    names = rooted.groupBy("_root").agg(F.min("node_id").alias("component"))
    return rooted.join(names, "_root").select("node_id", "component")


def summary(node: DataFrame, edge: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Counts, degree figures, temporal density, optionally components (GR12, GR14, GR15)."""
    n = node.agg(F.count("*").alias("node_count"), F.count_if(F.col("label") == "Session").alias("_s"))
    e = edge.agg(F.count("*").alias("edge_count"), F.count_if(F.col("rel_type").isin(*TEMPORAL_EDGES)).alias("_t"))
    d = degrees(edge).agg(F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))
    out = n.crossJoin(e).crossJoin(d)
    out = out.select(
        "node_count", "edge_count", F.coalesce("mean_degree", F.lit(0.0)).alias("mean_degree"), F.coalesce("max_degree", F.lit(0)).alias("max_degree"),
        (F.col("_t") / F.greatest(F.col("_s") - 1, F.lit(1))).alias("temporal_density"),
        F.when(F.col("node_count") > 1, 2 * F.col("edge_count") / (F.col("node_count").cast("double") * (F.col("node_count") - 1))).otherwise(0.0).alias("density"),
    )
    if components is not None:
        out = out.crossJoin(components.agg(F.count_distinct("component").alias("num_components")))
    return out


def user_density(session: DataFrame) -> DataFrame:
    """Sessions, first, last and the density figure per user (GR13)."""
    n = F.count("*")
    return session.groupBy("user_id").agg(
        n.alias("sessions"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.when(n > 1, n.cast("double")).otherwise(0.0).alias("density"),
    )


def importance(degree: DataFrame, n: int | None = None) -> DataFrame:
    """Degree over the number of ranked nodes, highest first (GR16)."""
    total = degree.agg(F.count("*").alias("_n"))
    out = degree.crossJoin(F.broadcast(total)).select("node_id", "degree", (F.col("degree") / F.col("_n")).alias("importance"))
    return out.orderBy(F.desc("importance"), "node_id").limit(n) if n else out


def top_degrees(degree: DataFrame, n: int = 10) -> DataFrame:
    return degree.orderBy(F.desc("degree"), "node_id").limit(n)


# --- temporal chains ----------------------------------------------------------------------------
def chain_reach(session: DataFrame, key: str, order: Sequence[str], row_id: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """How many later sessions each session reaches along its user's chain (GR6, GR7).

    On a linear chain the session at position i reaches exactly the n - i later ones, so the
    reachable pairs are given by position and need not be written out.
    """
    rows = sequenced(session, [key], order, total="n", slice_rows=slice_rows)
    return rows.select(key, row_id, "pos", "n", (F.col("n") - F.col("pos")).alias("reaches"))


def chain_of(session: DataFrame, key: str, order: Sequence[str], row_id: str, start: object) -> DataFrame:
    """All ordered pairs (start, later session) of one start session (GR6)."""
    rows = sequenced(session, [key], order)
    first = rows.filter(F.col(row_id) == F.lit(start)).select(key, F.col("pos").alias("_p"), F.col(row_id).alias("from_id"))
    return rows.join(F.broadcast(first), key).filter(F.col("pos") > F.col("_p")).select("from_id", F.col(row_id).alias("to_id"), (F.col("pos") - F.col("_p")).alias("length"))


def chain_counts(reach: DataFrame, key: str) -> DataFrame:
    """Sessions and temporal paths per user (GR7)."""
    return reach.groupBy(key).agg(F.count("*").alias("sessions"), F.sum("reaches").alias("temporal_links"))


def ancestors(edge: DataFrame, rel_types: Sequence[str] = TEMPORAL_EDGES) -> DataFrame:
    """Longest distance of each node from a chain start in a general temporal DAG (GR6).

    Stretches of nodes with one predecessor are crossed by pointer doubling, so a chain of n sessions
    takes about log2(n) rounds. Only nodes with several predecessors are left for relaxation, which
    visits each level of them once. A cycle raises ValueError.
    """
    links = reliable_checkpoint(edge.filter(F.col("rel_type").isin(*rel_types)).select("src", "dst").distinct())
    ids = links.select(F.col("src").alias("node_id")).union(links.select("dst")).distinct()
    single = links.groupBy("dst").agg(F.min("src").alias("up"), F.count("*").alias("_in")).filter("_in = 1").select(F.col("dst").alias("node_id"), "up")
    # up: the node that far steps lead back to; anchors (starts and meeting points) point to themselves
    jumps = ids.join(single, "node_id", "left").select("node_id", F.coalesce("up", "node_id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("up").isNull().alias("anchor"))
    jumps = reliable_checkpoint(jumps)
    nodes, reach = jumps.count(), 1
    while not jumps.filter("NOT anchor").join(jumps.filter("NOT anchor").select(F.col("node_id").alias("up")), "up", "left_semi").isEmpty():
        if reach > nodes:
            raise ValueError("the temporal edges hold a cycle")
        onward = jumps.select(F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("far").alias("_far"))
        jumps = reliable_checkpoint(jumps.join(onward, "up").select("node_id", F.col("_up").alias("up"), (F.col("far") + F.col("_far")).alias("far"), "anchor"))
        reach *= 2
    # distances between anchors: a meeting point is one step from each predecessor, which lies far from its anchor
    meeting = jumps.filter("anchor").select(F.col("node_id").alias("dst")).join(links, "dst")
    steps = meeting.join(jumps.select(F.col("node_id").alias("src"), "up", "far"), "src").groupBy("up", "dst").agg((F.max("far") + 1).alias("cost"))
    steps = reliable_checkpoint(steps)
    level = reliable_checkpoint(jumps.filter("anchor").select("node_id", F.lit(0).cast("long").alias("level")))
    anchors, rounds = level.count(), 0
    while True:
        gain = level.select(F.col("node_id").alias("up"), "level").join(steps, "up").groupBy(F.col("dst").alias("node_id")).agg(F.max(F.col("level") + F.col("cost")).alias("_l"))
        new = reliable_checkpoint(level.join(gain, "node_id", "left").select("node_id", F.greatest("level", F.coalesce("_l", F.lit(0))).alias("level"), (F.coalesce("_l", F.lit(0)) > F.col("level")).alias("grew")))
        level = new.drop("grew")
        if new.filter("grew").isEmpty():
            break
        rounds += 1
        if rounds > anchors:
            raise ValueError("the temporal edges hold a cycle")
    base = level.select(F.col("node_id").alias("up"), "level")
    return jumps.join(base, "up").select("node_id", (F.col("level") + F.col("far")).alias("level"))


def unlinked_pairs(pairs: DataFrame, edge: DataFrame) -> DataFrame:
    """Consecutive sessions without a temporal edge in either direction (JN15).

    ``pairs`` has ``a, b`` in the ids of ``edge``.
    """
    linked = edge.filter(F.col("rel_type").isin(*TEMPORAL_EDGES)).select(F.least("src", "dst").alias("_l"), F.greatest("src", "dst").alias("_h")).distinct()
    rows = pairs.withColumns({"_l": F.least("a", "b"), "_h": F.greatest("a", "b")})
    return rows.join(linked, ["_l", "_h"], "left_anti").select("a", "b")


def sort_key(node_id: Column | str) -> Column:
    """An id from its end. Ids of a label begin alike, and a sort that compares their first bytes has to compare them whole."""
    return F.reverse(node_id)


def dangling(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Edges with an end that is no node (JN14). Edges move twice, once by each end."""
    ids = node.select(sort_key("node_id").alias("_id")).distinct()
    rows = edge.withColumns({"src": sort_key("src"), "dst": sort_key("dst")})
    rows = rows.join(ids.select(F.col("_id").alias("src"), F.lit(True).alias("_s")), "src", "left")
    rows = rows.join(ids.select(F.col("_id").alias("dst"), F.lit(True).alias("_d")), "dst", "left").filter("_s IS NULL OR _d IS NULL")
    return rows.withColumns({"src": sort_key("src"), "dst": sort_key("dst")}).select(*edge.columns)


# --- building -----------------------------------------------------------------------------------
def _nid(label: str, value) -> F.Column:
    return F.concat(F.lit(label + ":"), value.cast("string"))


def build_edges(sessions: DataFrame) -> DataFrame:
    """Edges of wide session rows: user, dataset, feature and prediction links (GR17)."""
    s = _nid("Session", F.col("session_id"))

    def e(src, dst, kind, cond=None):
        row = F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("rel_type"))
        return row if cond is None else F.when(cond, row)

    feature = lambda name, mod: _nid(name, F.concat_ws("_", F.col("session_id").cast("string"), F.lit(mod)))
    rows = F.array_compact(F.array(
        e(_nid("User", F.col("participant_id")), s, "HAS_SESSION"),
        e(s, _nid("Dataset", F.col("dataset")), "PART_OF_DATASET"),
        e(s, feature("AudioFeature", "audio"), "HAS_FEATURE", F.col("has_audio")),
        e(s, feature("VisualFeature", "visual"), "HAS_FEATURE", F.col("has_visual")),
        e(s, feature("TextFeature", "text"), "HAS_FEATURE", F.col("has_transcript")),
        e(s, _nid("Prediction", F.concat(F.lit("pred_"), F.col("session_id").cast("string"))), "PREDICTED", F.col("label").isNotNull()),
    ))
    return sessions.select(F.explode(rows).alias("e")).select("e.*")


def nodes_of(edge: DataFrame) -> DataFrame:
    """Distinct end nodes of an edge list, labels read from the ids."""
    ends = edge.select(F.col("src").alias("node_id")).unionAll(edge.select("dst")).distinct()
    return ends.select("node_id", F.split("node_id", ":")[0].alias("label"))


def temporal_edges(session: DataFrame, key: str, order: Sequence[str], row_id: str, kinds=TEMPORAL_EDGES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Two temporal edges between each user's consecutive sessions (GR18)."""
    rows = sequenced(session, [key], order, {"_before": row_id}, slice_rows=slice_rows).filter("_before IS NOT NULL")
    return rows.select(_nid("Session", F.col("_before")).alias("src"), _nid("Session", F.col(row_id)).alias("dst"), F.explode(F.array(*[F.lit(k) for k in kinds])).alias("rel_type"))


def remembered_chain(session: DataFrame, key: str, order: Sequence[str], n: int = 12) -> DataFrame:
    """The last sessions a builder still remembers per user (GR18)."""
    return latest_per(session, [key], [F.col(c).desc() for c in order], n)


def clinical_edges(facts: DataFrame) -> DataFrame:
    """Emotion and symptom maps to weighted edges, closed vocabularies only (GR19).

    ``facts`` has ``session_id, emotions MAP<STRING,DOUBLE>, symptoms MAP<STRING,DOUBLE>``.
    """
    def part(column, label, kind, names):
        rows = facts.select("session_id", F.explode(column).alias("name", "weight")).filter(F.col("name").isin(*names))
        return rows.select(
            _nid("Session", F.col("session_id")).alias("src"),
            _nid(label, F.concat_ws("_", F.col("session_id").cast("string"), F.col("name"))).alias("dst"),
            F.lit(kind).alias("rel_type"), F.col("weight").cast("double").alias("confidence"),
        )

    return part("emotions", "Emotion", "EXPRESSES", GRAPH_EMOTIONS).unionByName(part("symptoms", "Symptom", "INDICATES", GRAPH_SYMPTOMS))


def research_edges(sessions: DataFrame, study: str, model: str) -> DataFrame:
    """Study and model-version links per user (GR20)."""
    user = _nid("User", F.col("participant_id"))
    rows = F.array(
        F.struct(user.alias("src"), F.lit(f"ResearchStudy:{study}").alias("dst"), F.lit("BELONGS_TO").alias("rel_type")),
        F.struct(user.alias("src"), F.lit(f"ModelVersion:{model}").alias("dst"), F.lit("USES_MODEL").alias("rel_type")),
    )
    return sessions.select("participant_id").distinct().select(F.explode(rows).alias("e")).select("e.*")


BUILDERS = {
    "session": lambda s, **_: build_edges(s),
    "temporal": lambda s, **_: build_edges(s).unionByName(temporal_edges(s, "participant_id", ["session_id"], "session_id")),
    "research": lambda s, study="study", model="model", **_: build_edges(s).unionByName(research_edges(s, study, model)),
}


def build_graph(name: str, sessions: DataFrame, **options) -> DataFrame:
    """Edge builder by name (UDF5)."""
    if name not in BUILDERS:
        raise KeyError(f"unknown builder {name}; known: {sorted(BUILDERS)}")
    return BUILDERS[name](sessions, **options)


# --- vectors on the graph -----------------------------------------------------------------------
#: Neighbours in a row of a node's list; a node with more has several rows.
NEAR = 1000
#: Ranges of hashes that links are counted by, to see whether any node may be heavy.
RANGES = 65_536


def neighbour_lists(pairs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``src, chunk, near``: the links out of a node as lists of at most ``NEAR`` ends, by hash, dealt by ``src``.

    Links move once. When some range of hashes has over ``slice_rows`` links, they are numbered in slices
    (``sequenced``) before, else a node's links are one task's.
    """
    buckets = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.select("src", "dst").filter("src IS NOT NULL")
    most = rows.groupBy(F.pmod(F.xxhash64("src"), F.lit(RANGES))).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > slice_rows:
        rows = sequenced(rows.withColumn("_o", F.xxhash64("dst")), ["src"], ["_o", "dst"], slice_rows=slice_rows).drop("_o")
        rows = rows.withColumn("_c", F.expr(f"(pos - 1) DIV {NEAR}")).repartition(buckets, "src")
    else:
        # sorted by hashes first, as the ids of a label begin alike
        rows = rows.repartition(buckets, "src").select("src", "dst", F.xxhash64("src").alias("_h"), F.xxhash64("dst").alias("_o"))
        rows = rows.withColumn("_c", F.expr(f"(row_number() OVER (PARTITION BY _h, src ORDER BY _o, dst) - 1) DIV {NEAR}"))
    ends = F.array_sort(F.collect_list(F.struct(F.xxhash64("dst").alias("o"), F.col("dst").alias("dst"))))
    lists = rows.groupBy(F.xxhash64("src").alias("_h"), "src", F.col("_c").cast("long").alias("chunk")).agg(ends.alias("near"))
    return dealt(lists.select("src", "chunk", F.col("near.dst").alias("near")), "src", moved=True)


def random_walks(edge: DataFrame, roots: DataFrame, length: int = 10, walks: int = 20, seed: int = 42, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Uniform walks as rows ``(root, walk, step, node_id)`` (GR21).

    Neighbours stand in lists of bounded size, ordered by hash and dealt by node once; the next one is picked by a
    hash of the walk's key. So a step moves the walks alone, to the list of the node they are at, and never the links. A hub has many lists,
    dealt by their number too, and its walks go to the one with the link they pick. Walks are far more than their roots' size lets
    Spark expect, hence the hints: they are never sent to the driver for a broadcast.
    """
    written = reliable_checkpoint(edge.select("src", "dst"))
    lists = neighbour_lists(symmetric(written), slice_rows)
    hubs = reliable_checkpoint(lists.filter("chunk > 0").groupBy("src").agg(F.max(F.col("chunk") * NEAR + F.size("near")).alias("deg")))
    dropped(written)
    far = None if hubs.isEmpty() else dealt(lists.join(hubs.select("src"), "src", "left_semi"), "src", "chunk")
    every = F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk")
    out = roots.select("root", every, F.col("root").alias("node_id"), F.lit(0).alias("step"))
    at = roots.select("root", F.col("root").alias("node_id"))
    for step in range(1, length):
        rest = ["walk"] if step > 1 else [every]  # walks of a root part where its list is

        def picked(near: DataFrame, deg: str, step: int = step) -> DataFrame:
            pick = F.pmod(F.xxhash64("root", "walk", F.lit(step), F.lit(seed)), F.col(deg))
            return near.withColumn("_deg", F.size("near")).select("root", "walk", F.element_at("near", (pick % NEAR + 1).cast("int")).alias("node_id"))

        if far is None:
            met = lists.join(at.hint("shuffle_hash"), lists["src"] == at["node_id"]).select("root", *rest, "near")
            to = picked(met, "_deg")
        else:
            here = at.select("root", *rest, "node_id").hint("merge").join(hubs.withColumnRenamed("src", "node_id"), "node_id", "left")
            few = here.filter("deg IS NULL").hint("shuffle_hash")
            to = picked(lists.join(few, lists["src"] == few["node_id"]), "_deg")
            chunk = F.expr(f"CAST(pmod(xxhash64(root, walk, {step}, {seed}), deg) AS BIGINT) DIV {NEAR}")
            many = here.filter("deg IS NOT NULL").select("root", "walk", F.col("node_id").alias("src"), "deg", chunk.alias("chunk")).hint("shuffle_hash")
            to = to.unionByName(picked(far.join(many, ["src", "chunk"]), "deg"))
        at = reliable_checkpoint(to)
        out = out.unionByName(at.select("root", "walk", "node_id", F.lit(step).alias("step")))
    dropped(lists, hubs, *([] if far is None else [far]))
    return out


#: Steps of a walk that are compared with one another.
PIECE = 32


def co_occurrence(walks: DataFrame, window: int = 2, piece: int = PIECE) -> DataFrame:
    """Symmetric counts of nodes met within ``window`` steps of each other.

    Walks move once, by walk, and are joined with themselves there; walks longer than ``piece`` steps are cut into pieces,
    so that work grows with the length. A pair counts in one direction only until it is counted. Roots are compared from their ends.
    """
    longest = walks.agg(F.max("step")).first()[0] or 0
    key = [sort_key("root").alias("_r"), "walk"]
    left = right = walks.select(*key, "step", "node_id")
    same = ["_r", "walk"]
    if longest >= max(piece, window):
        piece = max(piece, window)
        left = left.withColumn("_p", F.explode(F.expr(f"sequence((step + 1) DIV {piece}, (step + {window}) DIV {piece})")))
        right = right.withColumn("_p", F.expr(f"step DIV {piece}"))
        same = [*same, "_p"]
    left = left.select(*same, F.col("step").alias("_s"), F.col("node_id").alias("a"))
    right = right.select(*same, F.col("step").alias("_t"), F.col("node_id").alias("b"))
    met = left.hint("merge").join(right, same).filter(F.col("_t").between(F.col("_s") + 1, F.col("_s") + window))
    once = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (F.col("n") * 2).alias("n")))).otherwise(
        F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n")))
    return once.select(F.explode(both).alias("p")).select("p.*")


def walk_steps(walks: DataFrame, edge: DataFrame) -> DataFrame:
    """Rows ``root, walk, step, broken`` of the walks: whether the step to the next node follows no link (GR21).

    Walks move by root alone. The pairs of nodes they go between are made distinct and held against the links; only those that no
    link has are written and brought back to the walks.
    """
    at = walks.repartition("root").withColumn("_h", F.xxhash64("root"))
    after = at.withColumn("_n", F.expr("lead(struct(step, node_id)) OVER (PARTITION BY _h, root, walk ORDER BY step)"))
    moves = after.withColumn("_to", F.when(F.col("_n.step") == F.col("step") + 1, F.col("_n.node_id")))
    a, b = sort_key("node_id"), sort_key("_to")
    moves = moves.select("root", "walk", "step", F.when(b.isNotNull(), F.least(a, b)).alias("_l"), F.when(b.isNotNull(), F.greatest(a, b)).alias("_g"))
    linked = edge.filter("src IS NOT NULL AND dst IS NOT NULL").select(F.least(sort_key("src"), sort_key("dst")).alias("_l"), F.greatest(sort_key("src"), sort_key("dst")).alias("_g"))
    loose = reliable_checkpoint(moves.filter("_l IS NOT NULL").select("_l", "_g").distinct().hint("merge").join(linked, ["_l", "_g"], "left_anti"))
    rows = moves.join(loose.withColumn("broken", F.lit(True)), ["_l", "_g"], "left")
    return rows.select("root", "walk", "step", F.coalesce("broken", F.lit(False)).alias("broken"))


#: A prime whose squares fit in 64 bits; fifth powers are one to one modulo it.
START_PRIME = 2_147_483_647


def _start_vectors(node: DataFrame, dim: int, seed: int) -> DataFrame:
    """Seeded pseudo-normal vectors, replayable: sums of twelve uniforms.

    A node's MD5 gives the start and the step of a progression modulo a prime; its fifth powers are the
    uniforms. Only integer arithmetic is done per dimension.
    """
    def part(first: int) -> F.Column:
        return F.pmod(F.conv(F.substring("h", first, 8), 16, 10).cast("long"), F.lit(START_PRIME))

    def uniform(j: F.Column) -> F.Column:
        t = (F.col("s") + j * F.col("step")) % START_PRIME
        t2 = t * t % START_PRIME
        return (t2 * t2 % START_PRIME) * t % START_PRIME / float(START_PRIME)

    nodes = node.select("node_id").distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "node_id")))
    rows = nodes.select("node_id", part(1).alias("s"), part(9).alias("step"), F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d"))
    return rows.select("node_id", "d", (sum((uniform(F.col("d").cast("long") * 12 + i) for i in range(12)), F.lit(0.0)) - 6.0).alias("x"))


def projected_vectors(node: DataFrame, edge: DataFrame, dim: int = 64, rounds: int = 3, seed: int = 0) -> DataFrame:
    """Each round adds half the neighbours' previous vectors, then scales to unit length (GR22)."""
    links = symmetric(edge).groupBy("src", "dst").agg(F.count("*").alias("m"))
    rows = reliable_checkpoint(_start_vectors(node, dim, seed))
    for _ in range(rounds):
        pulled = links.join(rows, links["dst"] == rows["node_id"]).groupBy(F.col("src").alias("node_id"), "d").agg((F.sum(F.col("x") * F.col("m")) * 0.5).alias("y"))
        mixed = rows.join(pulled, ["node_id", "d"], "left").select("node_id", "d", (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("x"))
        norms = mixed.groupBy("node_id").agg((F.sqrt(F.sum(F.col("x") * F.col("x"))) + 1e-8).alias("l"))
        rows = reliable_checkpoint(mixed.join(norms, "node_id").select("node_id", "d", (F.col("x") / F.col("l")).alias("x")))
    return rows


def neighbour_mean(edge: DataFrame, features: DataFrame) -> DataFrame:
    """Mean over a node and its neighbours per dimension (GR23). ``features`` has ``node_id, d, x``.

    Links move once, to the features, and sums once to their nodes; beyond ``PART_LINKS`` links, part by part of the nodes.
    """
    written = reliable_checkpoint(edge.select("src", "dst"))
    parts = parts_for(2 * written.count())
    own = features.select("node_id", "d", "x")
    if parts > 1:
        own = dealt(own, "node_id", parts=parts)
    links = symmetric(written).filter("src <> dst")

    def means(part: int) -> DataFrame:
        to, mine = (links.filter(in_part("src", parts, part)), own.filter(in_part("node_id", parts, part))) if parts > 1 else (links, own)
        to = to.repartition("dst").distinct()
        near = to.join(own, to["dst"] == own["node_id"]).select(F.col("src").alias("node_id"), "d", "x")
        return mine.unionByName(near).groupBy("node_id", "d").agg(F.avg("x").alias("x"))

    out = by_parts(parts, means)
    if parts > 1:
        dropped(written, own)
    return out


def graph_vector(features: DataFrame, group: str, dim: int = 64) -> DataFrame:
    """Mean vector per graph, cut or zero-padded to ``dim`` (GR24), as rows."""
    means = features.groupBy(group, "d").agg(F.avg("x").alias("x")).filter(F.col("d") < dim)
    grid = features.select(group).distinct().withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))))
    return grid.join(means, [group, "d"], "left").select(group, "d", F.coalesce("x", F.lit(0.0)).alias("x"))


def batched_adjacency(edge: DataFrame, group: str) -> DataFrame:
    """Symmetric edge list with its graph id and the padded size of the batch (GR28)."""
    both = symmetric(edge.select(group, "src", "dst")).distinct()
    sizes = both.groupBy(group).agg(F.count_distinct("src").alias("nodes"))
    return both.join(sizes, group).crossJoin(F.broadcast(sizes.agg(F.max("nodes").alias("padded_to"))))


# --- store-like operations ----------------------------------------------------------------------
def two_levels(edge: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct out-neighbours of first and second level and their sum per root (GR25)."""
    links = edge.select("src", "dst").distinct()
    one = roots.join(links, roots["root"] == links["src"], "left").select("root", F.col("dst").alias("n1"))
    two = one.join(links, one["n1"] == links["src"], "left").select("root", F.col("dst").alias("n2")).distinct()
    a = one.groupBy("root").agg(F.count("n1").alias("level1"))
    b = two.groupBy("root").agg(F.count("n2").alias("level2"))
    return a.join(b, "root").withColumn("node_count", F.col("level1") + F.col("level2"))


def upserted_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace nodes by id, the later arrival wins (GR27). Both have ``node_id, label, props, arrival``."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c != "node_id"]
    return rows.groupBy("node_id").agg(F.max_by(F.struct(*rest), "arrival").alias("_r")).select("node_id", "_r.*")


def edges_from(edge: DataFrame, node_id: str) -> DataFrame:
    return edge.filter(F.col("src") == node_id)


def edges_to(edge: DataFrame, node_id: str) -> DataFrame:
    return edge.filter(F.col("dst") == node_id)


def nodes_by_label(node: DataFrame, label: str) -> DataFrame:
    return node.filter(F.col("label") == label)


def snapshot(table: DataFrame, snapshot_id: str, version: str = "1.0.0") -> DataFrame:
    """Rows of a node or edge table stamped for an append-only store of snapshots (GR27)."""
    return table.withColumns({"snapshot_id": F.lit(snapshot_id), "snapshot_version": F.lit(version)})


def restore(store: DataFrame, snapshot_id: str) -> DataFrame:
    """A table as it was when the snapshot was taken (GR27)."""
    return store.filter(F.col("snapshot_id") == snapshot_id).drop("snapshot_id", "snapshot_version")


# --- export -------------------------------------------------------------------------------------
def _xml(text) -> F.Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def graphml_lines(node: DataFrame, edge: DataFrame) -> DataFrame:
    """One XML element per row (SNK7); ``part`` orders nodes before edges."""
    n = node.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("node_id")), F.lit('"><data key="label">'), _xml(F.col("label")), F.lit("</data></node>")).alias("line"))
    e = edge.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"><data key="type">'), _xml(F.col("rel_type")), F.lit("</data></edge>")).alias("line"))
    return n.unionByName(e)


def edge_index(node: DataFrame, edge: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Dense numbers for nodes and edges between them; dangling edges fall away (SNK9)."""
    ids = numbered_nodes(node, slice_rows)
    a = ids.select(F.col("node_id").alias("src"), F.col("idx").alias("src_idx"))
    b = ids.select(F.col("node_id").alias("dst"), F.col("idx").alias("dst_idx"))
    return edge.join(a, "src").join(b, "dst").select("src_idx", "dst_idx", "rel_type")


def numbered_nodes(node: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Numbers 0.. by (hash, id): hash ranges are counted first, then numbered separately."""
    rows = node.select("node_id").distinct().withColumn("_h", F.xxhash64("node_id")).withColumn("_b", F.pmod(F.col("_h"), F.lit(4096)))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = sizes.selectExpr("_b", "coalesce(sum(_n) OVER (ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _start")
    inner = sequenced(rows, ["_b"], ["_h", "node_id"], slice_rows=slice_rows)
    # at most 4096 rows
    return inner.join(F.broadcast(starts), "_b").select("node_id", (F.col("_start") + F.col("pos") - 1).alias("idx"))
