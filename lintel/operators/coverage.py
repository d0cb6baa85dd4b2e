"""Raising the share of records whose chosen entry their own queries find, within budgets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.operators import linkage
from lintel.operators.shared import written


@dataclass
class Coverage:
    covered: int
    total: int
    calls: int
    template_weights: dict[str, float]
    stats: dict[str, tuple[int, int]] = field(default_factory=dict)


def train_coverage(candidates: DataFrame, index: DataFrame, truth: DataFrame, weights: dict[str, float], iterations: int = 10, calls: int = 200, limit: int = 5) -> Coverage:
    """Asks the best queries of uncovered records, a share of the budget each, and reweighs templates by their hits.

    The loop holds counts and template weights alone; records, queries and hits stay tables. A record
    stops asking at its first hit.
    """
    weights = dict(weights)
    total, queries = truth.count(), candidates.count()
    open_records, used, stats = truth, 0, {}
    for _ in range(iterations):
        n = open_records.count()
        each = (calls - used) // n if n else 0
        if each < 1:
            break
        chosen = linkage.select_queries(candidates.join(open_records.select("album_id"), "album_id", "left_semi"), each, weights)
        top = linkage.top_of_each(index, ["query"], limit, "pos", "id").join(truth.select("album_id", F.col("truth_id").alias("id")), "id")
        hit = chosen.join(top.select("album_id", "query", F.lit(True).alias("hit")), ["album_id", "query"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        first = hit.groupBy("album_id").agg(F.min(F.when(F.col("hit"), F.col("place"))).alias("first"))
        asked = written(hit.join(first, "album_id").where("first IS NULL OR place <= first"))
        by_template = asked.groupBy("template").agg(F.count(F.lit(1)).alias("a"), F.count_if("hit").alias("h")).collect()  # one row per template
        covered_now = asked.where("hit").select("album_id").distinct()
        used += sum(r["a"] for r in by_template)
        for r in by_template:
            a, h = stats.get(r["template"], (0, 0))
            stats[r["template"]] = (a + r["a"], h + r["h"])
        for template, (a, h) in stats.items():
            weights[template] = weights.get(template, 0.5) * (0.5 + h / a)
        left = written(open_records.join(covered_now, "album_id", "left_anti"))
        if left.count() == n and each >= queries:
            break
        open_records = left
    return Coverage(total - open_records.count(), total, used, weights, stats)
