"""What of a table goes on: titles that name something, rows not done yet, first sightings, tops, choices that stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions import text
from lintel.operators.runs import first_of_each


def names_work(title: Column) -> Column:
    """Whether a title may name a work: neither short, nor a year, nor a list of related items."""
    plain = F.trim(F.coalesce(title, F.lit("")))
    return ~((F.length(plain) < 5) | plain.rlike(r"^\d{4}$") | F.contains(plain, F.lit("Related Articles")))


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the done ones."""
    return rows.join(done.select(key), key, "left_anti")


def most_frequent(rows: DataFrame, key: str, order: str, shown: str, most: int = 5) -> DataFrame:
    """The most frequent keys, n, and what is shown of their first row; ties by first sighting."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, shown)).alias("_first"))
    return counted.orderBy(F.col("n").desc(), f"_first.{order}").limit(most).select(key, "n", f"_first.{shown}")


def first_texts(rows: DataFrame, keys: list[str], value: str, order: str, name: str = "fingerprint") -> DataFrame:
    """The first row of each key and whole normalised text, which a SHA-256 stands for."""
    return first_of_each(rows.withColumn(name, F.sha2(text.normalize(F.col(value)), 256)).drop(value), [*keys, name], order)


def standing_choices(rows: DataFrame, key: str, order: str, stands: Column) -> DataFrame:
    """Distinct keys of choices that stand, by first sighting, and unmatched, the number of rows whose choice does not."""
    first = rows.where(stands).groupBy(key).agg(F.min(order).alias(order))
    missed = rows.where(~F.coalesce(stands, F.lit(False))).agg(F.count(F.lit(1)).alias("unmatched"))
    return first.crossJoin(F.broadcast(missed))  # one row


def joined_texts(rows: DataFrame, keys: list[str], order: str, value: str, mark: str = "\n\n") -> DataFrame:
    """The texts of each key in order as one, without space at their ends. A key's texts make one row: they must fit into one."""
    parts = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: F.rtrim(x[value])), mark).alias("whole"))
