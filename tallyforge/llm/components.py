"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations (with partial sums before the shuffle) and two joins on node keys; the table is cut
with checkpoint(), so a lost executor costs no more than the current round. Only edges are touched, never documents,
and only one checksum row a round reaches the driver. The rounds grow as the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import ensure_checkpoint_dir


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v."""
    if larger:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if larger:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of the component.

    Self loops and repeated edges are fine; an empty table gives an empty table; null ends are dropped.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    work = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    mark = None
    while True:
        work = _star(_star(work, larger=True), larger=False).checkpoint()
        row = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    roots = work.select(F.col("v").alias("node")).distinct()
    return work.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
