"""Ordered building blocks: first of equals, islands, batches, ranges, relabelling, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.operators.shared import cut, written


def first_of_each(df: DataFrame, keys: Sequence[str | Column], *order: str | Column) -> DataFrame:
    """The first row of each key by a total order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def top_of_each(df: DataFrame, keys: Sequence[str | Column], n: int, *order: str | Column) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def with_runs(df: DataFrame, keys: Sequence[str], value: str, order: str, name: str = "run") -> DataFrame:
    """Numbers runs of equal neighbours from 1; nulls equal each other."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    starts = (F.row_number().over(ordered) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(ordered))
    return df.withColumn("_starts", starts.cast("int")).withColumn(name, F.sum("_starts").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def consecutive_ranges(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """lo and hi of the runs of consecutive distinct integers of each key."""
    island = F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return df.select(*keys, value).distinct().withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).drop("_island")


def with_batches(df: DataFrame, keys: Sequence[str], size: int, *order: str | Column, name: str = "batch") -> DataFrame:
    """Numbers batches of a fixed size from 0."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.floor((nth - 1) / size).cast("long"))


def with_appearance(df: DataFrame, keys: Sequence[str], value: str, order: str, name: str = "label_no") -> DataFrame:
    """Numbers values from 0 by first appearance within each key; null stays null."""
    first = F.min(order).over(Window.partitionBy(*keys, value))
    ranked = df.withColumn("_first", F.when(F.col(value).isNotNull(), first))
    return ranked.withColumn(
        name, F.when(F.col(value).isNotNull(), F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col("_first").asc_nulls_last())) - 1)
    ).drop("_first")


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Numbers all rows from 1 by a total order: range partitions, each led by the count of those before it."""
    # the bounds are sampled: rows and counts must see the same partitions
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in dealt.groupBy("_part").count().collect()):
        offsets.append((part, before))
        before += n
    led = dealt.join(F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _before long")), "_part")  # a row a partition
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return led.withColumn(name, F.col("_before") + nth).drop("_part", "_before")


def running_before(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """The sum of a value over the rows of the same key that come before, 0 for the first.

    Keys may be of any size: range partitions sum on their own, and each hands the total of its last key to the next.
    """
    spark = df.sparkSession
    dealt = written(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    key = F.struct(*keys)
    edges = dealt.groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))  # a row a partition
    totals = dealt.join(F.broadcast(edges), "_part").where(key.eqNullSafe(F.col("_last"))).groupBy("_part", "_first", "_last").agg(F.sum(value).alias("_total"))
    carried, last, total = [], None, 0
    for r in sorted(totals.collect(), key=lambda r: r["_part"]):
        ahead = total if last is not None and r["_first"] == last else 0
        carried.append((r["_part"], r["_first"], ahead))
        last, total = r["_last"], r["_total"] + (ahead if r["_first"] == r["_last"] else 0)
    schema = f"_part int, _first {edges.schema['_first'].dataType.simpleString()}, _ahead long"
    led = dealt.join(F.broadcast(spark.createDataFrame(carried, schema)), "_part")
    own = F.sum(value).over(Window.partitionBy("_part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.when(key.eqNullSafe(F.col("_first")), F.col("_ahead")).otherwise(0)
    return led.withColumn(name, F.coalesce(own, F.lit(0)) + ahead).select(*df.columns, name)


def upsert(old: DataFrame, new: DataFrame, key: str, position: str) -> DataFrame:
    """Old rows with new ones of the same key in their place, then the other new ones; numbered anew."""
    columns = [c for c in old.columns if c not in (key, position)]
    o, n = old.alias("o"), new.alias("n")
    merged = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key),
        *[F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns],
        F.col(f"o.{position}").alias("_old"),
        F.col(f"n.{position}").alias("_new"),
    )
    placed = numbered(merged, position, F.col("_old").asc_nulls_last(), F.col("_new").asc_nulls_last(), F.col(key).asc())
    return placed.select(key, *columns, position)


def side_by_side(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of two frames aligned by their place, the longer one kept whole."""
    l, r = numbered(left, "_row", left_order), numbered(right, "_row", right_order)  # noqa: E741
    return l.join(r, "_row", "full_outer").withColumnRenamed("_row", "row_no")


def descendants(edges: DataFrame, parent: str, child: str, roots: DataFrame) -> DataFrame:
    """All that the roots (a column named as child) reach along edges; a cycle is gone round once.

    Each round asks for the edges of what the round before it found, and ends when it finds nothing new.
    """
    steps = edges.select(F.col(parent).alias("_from"), F.col(child).alias(child)).where("_from IS NOT NULL")
    front, seen = roots.select(child), None
    while True:
        met = steps.join(front.select(F.col(child).alias("_from")), "_from").select(child).distinct()
        front = written(met if seen is None else met.join(seen, child, "left_anti"))
        if front.isEmpty():
            return front if seen is None else seen
        seen = front if seen is None else written(seen.unionAll(front))
