"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import reliable_checkpoint


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its smallest neighbour."""
    both = edges.union(edges.select("b", "a"))
    least = reliable_checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))  # written, so the join on a hub can be split
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (two columns, any order); root is the smallest node reachable.

    Loops, repeated edges and edges with a null end are ignored; no edges give no rows. Runs to the
    fixpoint, with no limit of rounds. Hot nodes are met by sums and joins only, never as a list.
    """
    now = reliable_checkpoint(edges.toDF("a", "b").dropna().filter("a <> b").distinct())
    mark = None
    while (new := _mark(now)) != mark:
        mark = new
        now = reliable_checkpoint(_small(_large(now)))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
