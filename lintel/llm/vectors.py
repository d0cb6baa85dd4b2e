"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null identifier inside tasks: it sorts after all others.
NO_ID = 2**63 - 1


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, *carried: Column, zero: bool) -> DataFrame:
    """number (of the row), id (``NO_ID`` for null), vector and carried columns of rows whose vectors can be compared.

    Vectors that are null or hold a null or a non-finite component take no part, nor do zero vectors unless ``zero``.
    Only vectors of one length can be compared: that of most rows, the larger of equally frequent ones.
    """
    vector = F.col(vector_col)
    infinite = F.lit(float("inf"))
    whole = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), vector.alias("vector"), *carried).where(whole if zero else whole & F.exists(vector, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    return rows.where(F.size("vector") == size).withColumn("number", F.monotonically_increasing_id())


def matrix(column: pd.Series, kind: type = np.float64) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind) if len(column) else np.zeros((0, 0), kind)
