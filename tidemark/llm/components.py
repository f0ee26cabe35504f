"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a min-aggregation and a join over the links; both keep the components and shorten paths, so that
the links become one star a component after a number of rounds that grows with the logarithm of the longest path.  Each
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import shared_folder


def _large_star(edges: DataFrame) -> DataFrame:
    """From the larger neighbours of a node to the smallest of it and its neighbours; links u > v, so that only those where
    the node is the larger end can name a smaller one.  The merge keeps small tables from the driver, which broadcasts would pass."""
    low = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    return edges.join(low.hint("merge"), F.col("v") == F.col("node"), "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """From a node and its smaller neighbours to the smallest of them; links u > v, also repeated ones."""
    low = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    ends = F.array(*(F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v")))
    moved = edges.join(low.hint("merge"), F.col("u") == F.col("node")).select(F.explode(ends).alias("x"))
    return moved.select("x.u", "x.v").where("u <> v").distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node is either the smaller end of its links or the larger end of one: then the smaller ends are the answer."""
    ends = F.array(*(F.struct(F.col(c).alias("node"), F.lit(int(c == "u")).alias("below"), F.lit(int(c == "v")).alias("above")) for c in ("u", "v")))
    ends = edges.select(F.explode(ends).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").count() == 0


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node) of every node of links ``u, v`` that is not itself the smallest.

    Sixty rounds are enough for paths of any length that a table can hold; should they not be, an error is raised.
    """
    shared_folder(links.sparkSession)
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    for _ in range(rounds):
        if _only_stars(edges):
            break
        edges = _small_star(_large_star(edges)).checkpoint()
    else:
        if not _only_stars(edges):
            raise RuntimeError(f"the links are no stars after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
