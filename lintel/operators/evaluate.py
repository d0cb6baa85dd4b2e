"""Rank of the truth, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truth_ranks(ranked: DataFrame, truth: DataFrame, auto: DataFrame | None = None) -> DataFrame:
    """album_id, truth_id, rank (0: not found), score, top_id and auto_id for every album with a truth."""
    top = ranked.where("rank = 1").select("album_id", F.col("id").alias("top_id"))
    found = ranked.select("album_id", F.col("id").alias("truth_id"), "rank", "score")
    out = truth.join(found, ["album_id", "truth_id"], "left").join(top, "album_id", "left")
    picks = auto.select("album_id", F.col("id").alias("auto_id")) if auto is not None else top.select("album_id", F.lit(None).cast("string").alias("auto_id"))
    return out.join(picks, "album_id", "left").select("album_id", "truth_id", F.coalesce("rank", F.lit(0)).alias("rank"), "score", "top_id", "auto_id")


def _mean(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def metrics(results: DataFrame) -> DataFrame:
    """One row of measures over the results of truth_ranks; zeros where there is nothing to measure."""
    fired, right = F.col("auto_id").isNotNull(), F.coalesce(F.col("auto_id") == F.col("truth_id"), F.lit(False))
    found = F.when(F.col("rank") > 0, F.col("score"))
    return results.agg(
        F.count(F.lit(1)).alias("n"),
        _mean(F.coalesce(F.col("top_id") == F.col("truth_id"), F.lit(False)).cast("double")).alias("precision_at_1"),
        _mean(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"),
        _mean(fired.cast("double")).alias("auto_coverage"),
        F.coalesce(F.sum(right.cast("int")) / F.nullif(F.sum(fired.cast("int")), F.lit(0)), F.lit(0.0)).alias("auto_accuracy"),
        _mean(right.cast("double")).alias("auto_recall"),
        F.coalesce(F.min(found), F.lit(0.0)).alias("score_min"),
        F.coalesce(F.median(found), F.lit(0.0)).alias("score_median"),
        _mean(found).alias("score_mean"),
        F.coalesce(F.max(found), F.lit(0.0)).alias("score_max"),
        F.count_if((F.col("rank") > 0) & ~F.coalesce(F.col("top_id") == F.col("truth_id"), F.lit(False))).alias("regressions"),
        F.count_if(F.col("rank") == 0).alias("lost"),
    )


def gates(measured: DataFrame, least_precision: float, least_recall: float) -> DataFrame:
    """passes: neither precision at 1 nor automatic recall is below its minimum."""
    return measured.withColumn("passes", (F.col("precision_at_1") >= least_precision) & (F.col("auto_recall") >= least_recall))


def status_counts(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One count per expected status, zeros included, others ignored."""
    return rows.agg(*[F.count_if(F.col(column) == k).alias(k) for k in keys])


def recall_by_limits(pairs: DataFrame, ranked: DataFrame, shared: DataFrame, queries: int) -> DataFrame:
    """One row: true pairs (item_id, doc_id), those that are found and lost, and their shares.

    ``ranked`` holds the pairs that the search proposes, with ranks; ``shared`` the first query (qpos) that a true pair shares, of all
    that an item could ask. A search asks the first ``queries`` of them and keeps a few documents of each: the last two
    shares tell what either limit costs.
    """
    met = pairs.join(ranked, ["item_id", "doc_id"], "left").join(shared, ["item_id", "doc_id"], "left")
    part = lambda n: F.round(F.coalesce(n / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 9)
    return met.agg(
        F.count_distinct("item_id").alias("items"),
        F.count(F.lit(1)).alias("pairs"),
        F.count("rank").alias("found"),
        F.count_if(F.col("rank").isNull()).alias("lost"),
        F.count_if(F.col("rank") <= 5).alias("in_first_5"),
        part(F.count("rank")).alias("recall"),
        part(F.count_if(F.col("qpos") < queries)).alias("recall_all_documents"),
        part(F.count("qpos")).alias("recall_all_queries"),
    )
