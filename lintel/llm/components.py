"""Connected components of a table of links, by alternating star contractions.

Each round replaces links by links to the smallest neighbour, first for larger neighbours, then
for smaller ones, and is written to the shared folder. It ends when a round changes nothing; the links
are then stars around the smallest node of each component. The centre of a large star has a row for
each of its links: such nodes meet their smallest neighbour by broadcast (see ``meet``), so that no
task takes all links of one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import meet, written


def _least_of(links: DataFrame) -> DataFrame:
    """u, its smallest neighbour m (or itself), and its number of links n."""
    return written(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return meet(both.where("v > u"), _least_of(both), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links here run from the larger node u to the smaller v."""
    least = _least_of(links)
    moved = meet(links, least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def star_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node with a link; root is the smallest node of its component."""
    current = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    state = None
    while True:
        found = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state or found[0] == 0:
            break
        state = tuple(found)
        current = written(_small_star(written(_large_star(current))))
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
