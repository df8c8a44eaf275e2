"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_folder


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    return both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to itself and its other smaller neighbours."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src <> dst")
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    return down.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").union(least.select("src", F.col("m").alias("dst"))).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(src, dst) of any orderable type -> (node, component): every node with an edge and the smallest node it reaches.

    The edges of each round are checkpointed, so the lineage stays short; all state stays in DataFrames, and
    the driver sees one row of totals a round. Self loops and repeated edges change nothing; null ends are dropped;
    no edges give no rows.
    """
    checkpoint_folder(edges.sparkSession)
    now = edges.select("src", "dst").dropna().filter("src <> dst")
    now = now.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = _small_star(_large_star(now)).checkpoint()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.union(now.select("dst", "dst")).distinct()
