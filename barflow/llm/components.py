"""Connected components of a table of links, without collecting anything: alternating large and small stars."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, root (smallest node reachable) for every node of the undirected links (a, b); each round halves the paths.

    Rounds go on until the links are settled. With `rounds`, links not settled after so many raise an error.

    A node's least neighbour is a pre-aggregated minimum, and joins back by node are split where a node is hot. Each round is
    written to the shared folder.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = _mark(edges)
    for k in count():
        if k == rounds:
            raise RuntimeError(f"links are not settled after {rounds} rounds")
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: a node's larger neighbours point to its least one
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours point to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # written, so that a join with it can split the rows of a hot node
    return written(roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
