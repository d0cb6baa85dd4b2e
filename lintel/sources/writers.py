"""Writers. Tables stay distributed; one file for people is written at the edge from a bounded table."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.operators.runs import running_before

#: Rows that a file for people may have.
EDGE_ROWS = 100_000


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object a line, in parts."""
    df.write.mode("overwrite").json(path)


def export_array(df: DataFrame, path: str, order: str) -> int:
    """A pretty JSON array in order, at most EDGE_ROWS long; more raises."""
    columns = [c for c in df.columns if c != order]
    rows = df.orderBy(order).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("j")).limit(EDGE_ROWS + 1).collect()
    if len(rows) > EDGE_ROWS:
        raise ValueError(f"more than {EDGE_ROWS} rows")
    Path(path).write_text(json.dumps([json.loads(r["j"]) for r in rows], ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return len(rows)


def request_batches(items: DataFrame, keys: list[str], item: str, order: str, size: int, distinct: bool = True) -> DataFrame:
    """keys, batch and ids: bodies of requests of a fixed size, in order. Nothing is sent. A key may have any number of items."""
    rows = items.select(*keys, item, order)
    if distinct:
        rows = items.groupBy(*keys, item).agg(F.min(order).alias(order))
    placed = running_before(rows.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", "_ahead")
    parts = F.array_sort(F.collect_list(F.struct(order, item)))
    return placed.groupBy(*keys, F.floor(F.col("_ahead") / size).cast("long").alias("batch")).agg(F.transform(parts, lambda x: x[item]).alias("ids"))


def write_model(model: DataFrame, path: str) -> None:
    """A training model (one row) as a JSON object."""
    row = model.select(F.to_json(F.struct("weights", "template_weights")).alias("j")).first()
    Path(path).write_text(json.dumps(json.loads(row["j"]), indent=2), encoding="utf-8")
