"""Connected components of a table of links, without links or components on the driver.

Alternating stars: each round links every node's larger neighbours to the smallest neighbour, then
every node's smaller neighbours, until each link is from a node to the smallest of its component.  The number of rounds grows with the logarithm of the longest path.  Each
round's links are a table in the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.llm import common


def _open(links: DataFrame) -> DataFrame:
    """Nodes with links to several smaller ones, or to a smaller and from a larger one; none if all is done."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1 AND down > 0")


def _star(links: DataFrame, tables: common.Tables) -> DataFrame:
    """Links of each v of a node u to the smallest of u and its v's."""
    least = links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return tables.write(least, "star").join(links, "u")


def components(links: DataFrame, tables: common.Tables | None = None) -> DataFrame:
    """node and component (its smallest node) of every node of `links` (u, v; any comparable type); rows with nulls do not count.

    The result reads from `tables`, new ones by default.
    """
    tables = tables or common.Tables(links.sparkSession)
    links = links.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = tables.write(links.distinct(), "links")
    while not _open(links).isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, tables).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        starred = _star(tables.write(down, "links"), tables)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
        links = tables.write(small.filter("u <> v").distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
