"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges of each node's larger neighbours to its smallest one. The minimum is taken before the shuffle, and adaptive execution splits the join of a node with very many edges."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst")))


def _clean(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .filter("src <> dst").distinct()
    )


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes that keep clean edges from being stars: those with several edges up, or with edges both up and down."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of all nodes that have a link; component is the smallest node reachable.

    links: two columns of ids, in any direction, repeats and self-links allowed; rows with
    a null id link nothing. Rounds go on until the edges are stars, each around its
    smallest node; each is written to the checkpoint folder, and no edge reaches the
    driver. An empty link table gives an empty result.
    """
    edges = links.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).dropna()
    edges = checkpoint(_clean(edges))
    while not _unsettled(edges).isEmpty():
        edges = checkpoint(_clean(_small_star(_large_star(edges))))
    roots = edges.select(F.col("dst").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
