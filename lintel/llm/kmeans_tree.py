"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample of rows (``FIT_ROWS``): directions fall into ``BRANCH`` clusters,
each of which is split again until a leaf stands for at most ``LEAF_ROWS`` times the root of the number of rows. All
rows are indexed: each goes down the tree to its leaf. A query takes leaves best bin first: a priority queue holds
the nodes that have been seen, the one whose centre is nearest comes next, and its children enter the queue.

How many leaves a query visits is calibrated: a bounded sample of rows (``CALIBRATED``) is searched
against all rows, and visits widen until ``RECALL`` of their true neighbours lie in visited leaves; all
queries then visit that many. Leaves are cut into blocks of rows, and blocks that many queries visit
into parts of the queries, so that neither a vector that a third of all rows share nor a frequent query
fills a task. Scores are cosines in double precision on the original vectors.

Defined results: vectors that are null, zero, hold null or non-finite components, or differ in length
from most take no part; rows are told apart by place, so rows that repeat an id are neighbours of each
other; ties go to the smaller id, null last; a null id is never a query; with fewer candidates than
``k`` all are returned as far as they are found; an empty table gives an empty result; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import written
from lintel.llm.vectors import NO_ID, matrix, usable_vectors

#: Rows that the tree is fitted on, children of a node, rows that a leaf stands for (times the root of all), and fitted rows of a leaf at least.
FIT_ROWS = 32_768
BRANCH = 8
LEAF_ROWS = 4.0
LEAF_FITTED = 8
ROUNDS = 12
#: Rows that calibrate the number of visits, and the share of their neighbours that visited leaves must hold.
CALIBRATED = 256
RECALL = 0.96
#: Rows and queries that meet in one task at a time.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 16_384
#: What single multiplications may differ by from the scores.
SLACK = 1e-9


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square leaves the range of doubles."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=1e-300)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two equally long matrices; one pair's cosine does not depend on what else is asked."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Tree:
    """Centres of all nodes, children by node (none: a leaf), and the number of each leaf."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, branch: int = BRANCH, seed: int = 0):
        self.rng = np.random.default_rng(seed)
        self.centres = [sample.mean(axis=0) if len(sample) else np.zeros(0)]
        self.children: list[list[int]] = [[]]
        self.leaf_of: dict[int, int] = {}
        self._split(0, sample, leaf_rows, branch)
        self.centres = np.array(self.centres)

    @property
    def leaves(self) -> int:
        return len(self.leaf_of)

    def _split(self, node: int, rows: np.ndarray, leaf_rows: int, branch: int) -> None:
        nearest, centres = self._clusters(rows, branch) if len(rows) > leaf_rows else (None, [])
        if len(centres) < 2:
            self.leaf_of[node] = len(self.leaf_of)
            return
        for c, centre in enumerate(centres):
            self.children[node].append(len(self.centres))
            self.centres.append(centre)
            self.children.append([])
            self._split(self.children[node][-1], rows[nearest == c], leaf_rows, branch)

    def _clusters(self, rows: np.ndarray, branch: int) -> tuple[np.ndarray, np.ndarray]:
        """The cluster of each row, and the clusters' centres; fewer than two if the rows are alike."""
        centres = np.unique(rows[self.rng.choice(len(rows), min(4 * branch, len(rows)), replace=False)], axis=0)
        centres = centres[self.rng.permutation(len(centres))[:branch]]
        for _ in range(ROUNDS):
            nearest = (rows @ centres.T).argmax(axis=1)
            used, nearest = np.unique(nearest, return_inverse=True)
            sums = np.zeros((len(used), rows.shape[1]))
            np.add.at(sums, nearest, rows)
            length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres[used])
        nearest = (rows @ centres.T).argmax(axis=1)
        used, nearest = np.unique(nearest, return_inverse=True)
        return nearest, centres[used]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(rows), np.int64)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            node, at = waiting.pop()
            if not self.children[node]:
                out[at] = self.leaf_of[node]
                continue
            nearest = (rows[at] @ self.centres[self.children[node]].T).argmax(axis=1)
            waiting += [(child, at[nearest == c]) for c, child in enumerate(self.children[node]) if (nearest == c).any()]
        return out

    def best_first(self, row: np.ndarray) -> Iterator[int]:
        """Leaves by the nearness of the centres that lead to them."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf_of[node]
                continue
            far = -(self.centres[self.children[node]] @ row)
            for distance, child in zip(far.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (distance, child))


def nearest_in_block(query: np.ndarray, query_number: int, rows: np.ndarray, units: np.ndarray, ids: np.ndarray, numbers: np.ndarray, near: np.ndarray, k: int) -> list[tuple[float, int, int]]:
    """score, id and number of the k nearest rows but the query's own; near: cosines as one multiplication gives them."""
    least = np.partition(near, len(near) - k - 1)[len(near) - k - 1] if len(near) > k else -2.0  # one more: the own row may be among them
    at = np.flatnonzero(near >= least - SLACK)
    at = at[numbers[at] != query_number]
    scores = cosines(np.broadcast_to(query, (len(at), len(query))), rows[at])
    best = np.lexsort((numbers[at], ids[at], -scores))[:k]
    return [(float(scores[b]), int(ids[at[b]]), int(numbers[at[b]])) for b in best]


def _true_neighbours(rows: DataFrame, numbers: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int]]:
    """For a bounded set of queries (place in it, leaf): the leaf of each of the k nearest of all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((numbers, vectors))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, queries = shared.value
        units = directions(queries)
        best: list[list[tuple[float, int, int, int]]] = [[] for _ in own]
        for batch in batches:
            if not len(batch):
                continue
            found = matrix(batch["vector"])
            ids, those, leaves = (batch[c].to_numpy(np.int64) for c in ("id", "number", "leaf"))
            near = units @ directions(found).T
            leaf_of = dict(zip(those.tolist(), leaves.tolist(), strict=True))
            for q in range(len(own)):
                new = nearest_in_block(queries[q], int(own[q]), found, found, ids, those, near[q], k)
                best[q] = sorted([*best[q], *((-s, i, n, leaf_of[n]) for s, i, n in new)])[:k]
        flat = [(q, s, i, n, leaf) for q, some in enumerate(best) for s, i, n, leaf in some]
        yield pd.DataFrame(flat, columns=["query", "far", "id", "number", "leaf"])

    found = rows.select("id", "number", "leaf", "vector").mapInPandas(search, "query int, far double, id long, number long, leaf long")
    nth = F.row_number().over(Window.partitionBy("query").orderBy("far", "id", "number"))
    return [tuple(r) for r in found.withColumn("nth", nth).where(F.col("nth") <= k).select("query", "leaf").collect()]


def calibrated_visits(tree: Tree, vectors: np.ndarray, truth: list[tuple[int, int]], recall: float = RECALL) -> int:
    """The least number of visited leaves that hold the wanted share of the true neighbours."""
    wanted: dict[int, list[int]] = {}
    for query, leaf in truth:
        wanted.setdefault(query, []).append(leaf)
    needed: list[int] = []
    units = directions(vectors) if len(vectors) else vectors
    for query, leaves in wanted.items():
        left = set(leaves)
        for visit, leaf in enumerate(tree.best_first(units[query]), 1):
            if leaf in left:
                needed += [visit] * leaves.count(leaf)
                left.discard(leaf)
                if not left:
                    break
    needed.sort()
    return needed[int(np.ceil(recall * len(needed))) - 1] if needed else 1


class Index:
    """All rows with their leaves, and the tree."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS, leaf_rows: float = LEAF_ROWS):
        rows = written(usable_vectors(vectors, id_col, vector_col, zero=False))
        self.total = rows.count()
        share = min(1.0, fit_rows / max(1, self.total))
        drawn = rows.where(F.pmod(F.xxhash64("number"), F.lit(1 << 20)) < int(share * (1 << 20))).select("vector").orderBy("vector").toPandas()  # fit_rows, give or take chance
        sample = directions(matrix(drawn["vector"])) if len(drawn) else np.zeros((0, 0))
        self.tree = Tree(sample, max(LEAF_FITTED, round(leaf_rows * self.total**0.5 * share)))
        shared = self.shared = rows.sparkSession.sparkContext.broadcast(self.tree)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(leaf=shared.value.assign(directions(matrix(batch["vector"]))))

        kind = rows.schema["vector"].dataType.simpleString()
        self.rows = written(rows.select("id", "number", "vector").mapInPandas(assign, f"id long, number long, vector {kind}, leaf long"))

    def calibrate(self, k: int, recall: float = RECALL, calibrated: int = CALIBRATED) -> int:
        drawn = self.rows.orderBy(F.xxhash64("number"), "number").limit(calibrated).select("number", "vector").toPandas()
        if not len(drawn):
            return 1
        vectors = matrix(drawn["vector"])
        return calibrated_visits(self.tree, vectors, _true_neighbours(self.rows, drawn["number"].to_numpy(np.int64), vectors, k), recall)

    def search(self, queries: Column, k: int, visits: int, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
        """query_id, rank, vec_id and score: the k nearest rows that are found for each row that is a query."""
        spark, shared = self.rows.sparkSession, self.shared

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lo in range(0, len(batch), 256):
                    some = batch.iloc[lo : lo + 256]
                    leaves = []
                    for row in directions(matrix(some["vector"])):
                        order = shared.value.best_first(row)
                        leaves.append([leaf for leaf, _ in zip(order, range(visits), strict=False)])
                    yield some.assign(leaf=leaves).explode("leaf").astype({"leaf": np.int64})

        kind = self.rows.schema["vector"].dataType.simpleString()
        asked = self.rows.where(queries & (F.col("id") != NO_ID)).select("id", "number", "vector")
        visited = written(asked.mapInPandas(visit, f"id long, number long, vector {kind}, leaf long"))

        # at most a row for each leaf of the tree
        per_leaf = self.rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
        per_visited = visited.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("parts"))
        sizes = F.broadcast(spark.createDataFrame([tuple(r) for r in per_leaf.join(per_visited, "leaf").collect()], "leaf long, blocks int, parts int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda n: F.pmod(F.xxhash64("number"), F.col(n)).cast("int")
        key = ["leaf", "block", "part"]
        data = self.rows.join(sizes, "leaf").select("leaf", dealt("blocks").alias("block"), every("parts").alias("part"), F.lit(False).alias("asks"), "id", "number", "vector")
        asking = visited.join(sizes, "leaf").select("leaf", every("blocks").alias("block"), dealt("parts").alias("part"), F.lit(True).alias("asks"), "id", "number", "vector")

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, held, block = None, [], None
            for batch in batches:
                out = []
                for at, group in batch.groupby(key, sort=False):
                    if at != now:
                        now, held, block = at, [], None
                    asks = group["asks"].to_numpy(bool)
                    if not asks.all():
                        held.append(group[~asks])
                    if not asks.any() or not held:  # chance may leave a block without rows
                        continue
                    if block is None:
                        some = pd.concat(held)
                        rows = matrix(some["vector"])
                        block = rows, directions(rows), some["id"].to_numpy(np.int64), some["number"].to_numpy(np.int64)
                    asking = group[asks]
                    vectors = matrix(asking["vector"])
                    for lo in range(0, len(asking), 256):
                        near = directions(vectors[lo : lo + 256]) @ block[1].T
                        for q, row in enumerate(near, lo):
                            number = int(asking["number"].iat[q])
                            out.extend((int(asking["id"].iat[q]), number, *x) for x in nearest_in_block(vectors[q], number, *block, row, k))
                if out:
                    yield pd.DataFrame(out, columns=["query_id", "query", "score", "vec_id", "number"])

        met = data.unionAll(asking).repartition(*key).sortWithinPartitions(*key, "asks").mapInPandas(meet, "query_id long, query long, score double, vec_id long, number long")
        nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "number"))
        best = met.withColumn("rank", nth).where(F.col("rank") <= k)
        return best.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, leaf_rows: float = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for the rows that ``queries`` (over the column ``id``) selects."""
    index = Index(vectors, id_col, vector_col, leaf_rows=leaf_rows)
    return index.search(queries, k, index.calibrate(k, recall))
