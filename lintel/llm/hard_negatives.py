"""Hard negatives by a two-dimensional block matrix multiplication.

Scores are inner products of integer vectors, anchors against all rows. Rows are dealt into shards of
``SHARD_ROWS``, dimensions into chunks of ``CHUNK``; a shard's chunk meets the anchors' same chunk, which
gives partial scores of 64-bit integers. The partial scores of an anchor and a shard are shuffled to
one place and added there. What remains of such a row of scores is: its best positives, and all its
scores of other labels in order. The positives of an anchor are the best over all shards; each opens a
window of scores. Windows go to the rows of scores, take their first few there, and the first few over
all shards are the result. Nothing is pruned, so the result is exact. Every (anchor, shard) is a key of
its own: no label and no anchor fills a task.

Defined results: rows whose label or vector is null, or whose vector holds a null or a non-finite
component or differs in length from most, take no part; rows are told apart by place, so rows that
repeat an id are each other's candidates; a null id is never an anchor, sorts after all others and
comes out as null; scores that 64-bit integers might not hold raise a ValueError; an empty table, or
one without anchors, gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import written
from lintel.llm.vectors import NO_ID, matrix, usable_vectors

SHARD_ROWS = 1024
CHUNK = 32
#: Anchors whose chunks are multiplied with a shard's at a time.
ANCHORS_AT_ONCE = 256

PARTIAL = "shard long, anchor long, anchor_id long, label int, chunk int, scores binary, ids binary, labels binary, numbers binary"


def _packed(numbers: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).tobytes())


def _unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """The rows with their vectors as integers, floor of scale times each component."""
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * scale)))


def _every_shard(shards: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")


def _largest(rows: DataFrame) -> tuple[int, int]:
    """Length of the vectors, and the largest magnitude of a component before the floor."""
    found = rows.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()
    return found[0] or 0, found[1] or 0.0


def partial_scores(rows: DataFrame, anchors: DataFrame, shards: int, size: int, exact_doubles: bool, chunk: int = CHUNK) -> DataFrame:
    """Partial scores of each anchor with each shard by chunks of the dimensions, and each shard's ids, labels and numbers (anchor -1)."""
    chunks = max(1, -(-size // chunk))
    parts = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    cut = F.slice("vector", F.col("chunk") * chunk + 1, chunk)
    shard = F.pmod(F.xxhash64("number"), F.lit(shards))
    data = rows.select(shard.alias("shard"), parts.alias("chunk"), F.lit(False).alias("asks"), "number", "id", "label", "vector")
    # a shard's chunk meets the same chunk of every anchor
    asking = anchors.select(_every_shard(shards), "number", "id", "label", "vector")
    asking = asking.select("shard", parts.alias("chunk"), F.lit(True).alias("asks"), "number", "id", "label", "vector")
    both = data.unionAll(asking).withColumn("vector", cut)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, block, none = None, [], None, None
        columns = [c.split()[0] for c in PARTIAL.split(", ")]

        def begun() -> pd.DataFrame:
            some = pd.concat(held)
            named = (_packed(some["id"].to_numpy(np.int64)), _packed(some["label"].to_numpy(np.int32)), _packed(some["number"].to_numpy(np.int64)))
            return pd.DataFrame([(now[0], -1, 0, 0, -1, none, *named)], columns=columns)

        for batch in batches:
            for at, group in batch.groupby(["shard", "chunk"], sort=False):
                if at != now:
                    now, held, block = at, [], None
                asks = group["asks"].to_numpy(bool)
                if not asks.all():
                    held.append(group[~asks])
                if not asks.any() or not held:
                    continue
                if block is None:
                    block = matrix(pd.concat(held)["vector"], np.float64 if exact_doubles else np.int64)
                    if at[1] == 0:
                        yield begun()
                asking = group[asks]
                for lo in range(0, len(asking), ANCHORS_AT_ONCE):
                    some = asking.iloc[lo : lo + ANCHORS_AT_ONCE]
                    scores = (matrix(some["vector"], block.dtype) @ block.T).astype(np.int64)
                    named = zip(some["number"], some["id"], some["label"], scores, strict=True)
                    yield pd.DataFrame([(at[0], n, i, label, at[1], _packed(row), none, none, none) for n, i, label, row in named], columns=columns)

    return both.repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "asks", "number").mapInPandas(multiply, PARTIAL)


def added_scores(partial: DataFrame, positives: int) -> DataFrame:
    """For each anchor and shard: the best scores of its label (score, id, number, as arrays), and all of other labels in order, packed.

    A shard's ids and labels come first in its partition, then its anchors one by one, chunk after chunk.
    """
    out_schema = "anchor long, anchor_id long, shard long, near array<struct<far:long, id:long, number:long>>, scores binary, ids binary"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, named, anchor, total = None, None, None, None

        def finished() -> tuple:
            ids, labels, numbers = named
            number, anchor_id, label = anchor
            own = np.flatnonzero((labels == label) & (numbers != number))
            best = own[np.lexsort((numbers[own], ids[own], -total[own]))[:positives]]
            near = [{"far": -int(total[b]), "id": int(ids[b]), "number": int(numbers[b])} for b in best]
            others = np.flatnonzero(labels != label)
            others = others[np.lexsort((ids[others], -total[others]))]
            return number, anchor_id, shard, near, _packed(total[others]), _packed(ids[others])

        for batch in batches:
            out = []
            for s, n, i, label, scores, *names in batch[["shard", "anchor", "anchor_id", "label", "scores", "ids", "labels", "numbers"]].itertuples(index=False):
                if total is not None and (s, n) != (shard, anchor[0]):
                    out.append(finished())
                    total = None
                if n < 0:
                    shard, named = s, (_unpacked(names[0]), _unpacked(names[1], np.int32), _unpacked(names[2]))
                    continue
                if total is None:
                    anchor, total = (int(n), int(i), int(label)), np.zeros(len(named[0]), np.int64)
                total = total + _unpacked(scores)
            if out:
                yield pd.DataFrame(out, columns=["anchor", "anchor_id", "shard", "near", "scores", "ids"])
        if total is not None:
            yield pd.DataFrame([finished()], columns=["anchor", "anchor_id", "shard", "near", "scores", "ids"])

    return partial.repartition("shard").sortWithinPartitions("shard", "anchor", "chunk").mapInPandas(add, out_schema)


def in_windows(rows_of_scores: DataFrame, windows: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """The first negatives of each window within each row of scores."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out_columns = ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative_id", "negative_score"]
        for batch in batches:
            out = []
            for anchor, anchor_id, scores, ids, of_anchor in batch[["anchor", "anchor_id", "scores", "ids", "windows"]].itertuples(index=False):
                scores, ids = _unpacked(scores), _unpacked(ids)
                rising = -scores
                for w in of_anchor:
                    score = int(w["positive_score"])
                    first = int(np.searchsorted(rising, -(high * score // 100), "left"))
                    last = int(np.searchsorted(rising, (-low * score) // 100, "right"))  # of -(low * score) / 100 the floor: minus its ceiling
                    for k in range(first, min(last, first + negatives)):
                        out.append((anchor, anchor_id, w["positive"], w["positive_id"], score, int(ids[k]), int(scores[k])))
            yield pd.DataFrame(out, columns=out_columns)

    met = rows_of_scores.select("anchor", "anchor_id", "shard", "scores", "ids").join(windows, ["anchor", "shard"])
    return met.mapInPandas(take, "anchor long, anchor_id long, positive long, positive_id long, positive_score long, negative_id long, negative_score long")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | Column = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchors`` is a condition on the column ``id``. A positive is one of the anchor's first rows of its own label; its
    negatives are the first rows of other labels whose score lies between low and high hundredths of the positive's.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = written(integer_vectors(usable_vectors(vectors, id_col, vector_col, label.cast("int").alias("label"), zero=True).where("label IS NOT NULL"), scale))
    size, largest = _largest(rows)
    bound = size * int(largest) ** 2
    if bound * 100 >= 2**63:
        raise ValueError(f"scores of up to {bound} do not fit 64-bit integers with their hundredths")
    shards = max(1, -(-rows.count() // shard_rows))
    asking = rows.where(anchors & (F.col("id") != NO_ID))
    scored = written(added_scores(partial_scores(rows, asking, shards, size, bound < 2**53, chunk), positives))

    near = scored.select("anchor", F.inline("near"))
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy("far", "id", "number"))
    best = near.withColumn("nth", nth).where(F.col("nth") <= positives)
    window = F.struct(F.col("number").alias("positive"), F.col("id").alias("positive_id"), (-F.col("far")).alias("positive_score"))
    windows = best.groupBy("anchor").agg(F.collect_list(window).alias("windows"))  # as many as positives at most
    windows = windows.select("anchor", _every_shard(shards), "windows")
    found = in_windows(scored, windows, negatives, low, high)
    nth = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = found.withColumn("rank", nth).where(F.col("rank") <= negatives)
    real = lambda c: F.nullif(c, F.lit(NO_ID)).alias(c)
    return ranked.select("anchor_id", real("positive_id"), "rank", real("negative_id"), "positive_score", "negative_score")
