"""Plug-in table functions: search back ends and line parsers that SQL calls with a table.

A plug-in is given rows of one partition in order and yields rows. It is registered under a name with
its result's schema; ``analyze`` tells Spark that schema, and how the table is partitioned and ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: Takes a row and the state of its partition (a dictionary, empty at first); gives rows.
Plugin = Callable[[Row, dict], Iterable[tuple]]


def register_plugin(spark: SparkSession, name: str, plugin: Plugin, schema: str, keys: list[str], order: list[str], last: Callable[[dict], Iterable[tuple]] | None = None) -> None:
    """Make ``SELECT * FROM name(TABLE(t))`` run a plug-in over each partition of ``t`` by the keys, in the order given.

    Rows stream through, so a partition is never held; ``last`` may yield rows when one ends. A table without the keys or
    the order's columns is refused when the query is analysed.
    """
    result = StructType.fromDDL(schema)
    needed = [*keys, *order]

    class Plugged:
        def __init__(self):
            self.state: dict = {}

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError(f"{name} takes a table")
            missing = [c for c in needed if c not in rows.dataType.fieldNames()]
            if missing:
                raise ValueError(f"{name} needs the columns {', '.join(missing)}")
            return AnalyzeResult(schema=result, partitionBy=[PartitioningColumn(k) for k in keys], orderBy=[OrderingColumn(c) for c in order])

        def eval(self, row: Row):
            yield from plugin(row, self.state)

        def terminate(self):
            if last is not None:
                yield from last(self.state)

    spark.udtf.register(name, udtf(Plugged))
