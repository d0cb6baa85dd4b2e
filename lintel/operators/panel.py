"""Rates as of a date, returns over periods, and a panel adjusted by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import values


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, order: str | None = None) -> DataFrame:
    """Every left row with the last right value of its keys at or before its time, or null.

    Both sides go into one sorted stream per key, so a row meets one value and not all earlier ones.
    """
    order = order or right_time
    columns = left.columns
    probes = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[order].dataType).alias("_o"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*columns).alias("_row"))
    known = right.where(F.col(value).isNotNull()).select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(order).alias("_o"), F.col(value).alias("_v"), F.lit(None).cast(probes.schema["_row"].dataType).alias("_row"))
    upto = Window.partitionBy(*keys).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    filled = known.unionByName(probes).withColumn(value, F.last("_v", ignorenulls=True).over(upto))
    return filled.where("_side = 1").select("_row.*", value)


def cross_rates(probes: DataFrame, rates: DataFrame, date: str, base: str, target: str) -> DataFrame:
    """Adds rate: units of target for one of base as of the date; null if either is unknown."""
    def side(df: DataFrame, code: str, name: str) -> DataFrame:
        known = rates.select(F.col("currency").alias(code), "rate_date", F.col("rate").alias(name))
        # a currency may be that of most rows: each of its dates is looked up once
        found = as_of(df.select(code, date).distinct(), known, [code], date, "rate_date", name)
        return df.join(found, [code, date], "left")

    both = side(side(probes, base, "_base"), target, "_target")
    return both.withColumn("rate", F.col("_target") / F.col("_base")).drop("_base", "_target")


def adjusted_panel(panel: DataFrame, rates: DataFrame, periods: list[str], as_of_column: str, base: str, target: str) -> DataFrame:
    """The panel with its percentages compounded by the return of the exchange rate over each period.

    Cells that are no percentage stay as they are; nothing changes between equal or missing currencies.
    Values come back as fractions in ``<period>`` and whether they were adjusted in ``applied``.
    """
    long = panel.unpivot([c for c in panel.columns if c not in periods], periods, "_period", "_cell")
    dated = long.withColumn("_end", F.col(as_of_column)).withColumn("_start", values.period_start(F.col(as_of_column), F.col("_period")))
    at_end = cross_rates(dated, rates, "_end", base, target).withColumnRenamed("rate", "_rate_end")
    both = cross_rates(at_end, rates, "_start", base, target).withColumnRenamed("rate", "_rate_start")
    own, fx = values.percent(F.col("_cell")), F.col("_rate_end") / F.col("_rate_start") - 1
    differ = (F.col(base) != "") & (F.col(target) != "") & (F.col(base) != F.col(target))
    changed = both.withColumn("_applied", differ & own.isNotNull() & fx.isNotNull()).withColumn("_value", F.when(F.col("_applied"), (1 + own) * (1 + fx) - 1).otherwise(own))
    ids = [c for c in panel.columns if c not in periods]
    wide = changed.groupBy(*ids).agg(*[F.max(F.when(F.col("_period") == p, F.col("_value"))).alias(p) for p in periods], F.bool_or("_applied").alias("applied"))
    return wide.select(*ids, *periods, "applied")


def without_header_rows(frame: DataFrame, periods: list[str]) -> DataFrame:
    """Rows that do not repeat the column names in all period columns (in all columns if there are none)."""
    same = None
    for name in periods or frame.columns:
        hit = F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == name
        same = hit if same is None else same & hit
    return frame.where(~same)


def stacked(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with differing columns, blanks for what is missing, each distinct row once."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.na.fill("").distinct()
