import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import hard_negatives, kmeans_tree, vectors

EXTRA = "number long, leaf long, block int, part int, shard long, asks boolean, id long, vector string, rank int, score double, chunk int, anchor long"
SCHEMA = f"vec_id long, embedding array<float>, label int, {EXTRA}"
NONE = (None,) * 12


def _frame(spark, rows):
    return spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], label, *NONE) for i, v, label in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, zero vectors, other lengths, copies, repeated ids, ties."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 6)).round(2)
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, rows[0][1], 1) for i in range(6)]  # one vector again and again
    rows += [(200, [2 * x for x in rows[0][1]], 0), (0, rows[5][1], 2), (0, rows[0][1], 0)]
    rows += [(None, rows[3][1], 1), (300, None, 1), (301, [0.0] * 6, 1), (302, [1.0, None, 0, 0, 0, 0], 1), (303, [float("nan")] * 6, 1)]
    rows += [(304, [float("inf")] + [0.0] * 5, 1), (305, [1.0, 2.0], 1), (306, [], 0), (307, rows[7][1], None)]
    return _frame(spark, rows)


def _usable(rows, zero):
    return [r for r in rows if r["embedding"] is not None and len(r["embedding"]) == 6 and all(x is not None and np.isfinite(x) for x in r["embedding"]) and (zero or any(r["embedding"]))]


def _nearest(rows, modulus, k):
    """Every query against every row."""
    ids = [r["vec_id"] for r in rows]
    own = np.array([r["embedding"] for r in rows], float)
    out = {}
    for q, i in enumerate(ids):
        if i is None or i % modulus:
            continue
        scored = [(-float(kmeans_tree.cosines(own[[q]], own[[c]])[0]), vectors.NO_ID if ids[c] is None else ids[c]) for c in range(len(rows)) if c != q]
        out.setdefault(i, []).append([(-s, None if c == vectors.NO_ID else c) for s, c in sorted(scored)[:k]])
    return {i: sorted(map(str, some)) for i, some in out.items()}


def _found(df, modulus):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(((r["score"], r["vec_id"]), r["rank"]))
    return out


@pytest.mark.parametrize(("block_rows", "block_queries"), [(kmeans_tree.BLOCK_ROWS, kmeans_tree.BLOCK_QUERIES), (3, 1)])
def test_all_leaves_give_the_exact_neighbours(odd, block_rows, block_queries):
    """With every leaf visited, whatever the blocks, the result is that of brute force, ties and repeated ids included."""
    index = kmeans_tree.Index(odd, leaf_rows=1.0)
    assert index.tree.leaves > 3
    df = index.search(F.col("id") % 5 == 0, 5, 10_000, block_rows, block_queries).orderBy("query_id", "rank")
    expected = _nearest(_usable(odd.collect(), False), 5, 5)
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"], r["rank"]))
    assert set(got) == set(expected) and 0 in got
    for i, some in got.items():
        assert len(some) == 5 * len(expected[i])
        if len(expected[i]) == 1:
            assert str([(s, c) for s, c, _ in some]) == expected[i][0]
            assert [k for *_, k in some] == [1, 2, 3, 4, 5]
        else:  # rows that share an id are queries of their own
            listed = sorted(x for one in expected[i] for x in eval(one))  # noqa: S307
            assert sorted((s, c) for s, c, _ in some) == listed


def test_few_rows_no_rows_and_a_null_id(spark, odd):
    assert kmeans_tree.nearest_neighbours(odd.where("false"), F.col("id") % 5 == 0).count() == 0
    few = kmeans_tree.nearest_neighbours(odd.where("vec_id IN (1, 2, 5)"), F.col("id") % 5 == 0).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(5, 1), (5, 2)]
    alone = kmeans_tree.nearest_neighbours(odd.where("vec_id = 5"), F.col("id") % 5 == 0)
    assert alone.count() == 0 and alone.columns == ["query_id", "rank", "vec_id", "score"]
    alike = _frame(spark, [(i, [1.0, 0.0], 0) for i in range(300)])
    found = kmeans_tree.nearest_neighbours(alike, F.col("id") == 7, leaf_rows=0.5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(i, 1.0) for i in range(5)]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    index = kmeans_tree.Index(df)
    visits = index.calibrate(5)
    assert index.tree.leaves > 4 and visits < index.tree.leaves
    found = {}
    for r in index.search(F.col("id") % 50 == 0, 5, visits).collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    rows = df.collect()
    truth = _nearest_pairs(rows, 50, 5)
    hits = sum(len({c for _, c in found[q]} & {c for _, c in truth[q]}) for q in truth)
    assert hits >= 0.9 * sum(map(len, truth.values()))
    for q, some in found.items():  # scores are those of the original vectors
        for s, c in some:
            a, b = (np.array(next(r["embedding"] for r in rows if r["vec_id"] == i), float) for i in (q, c))
            assert s == pytest.approx(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), abs=1e-14)


def _nearest_pairs(rows, modulus, k):
    ids = np.array([r["vec_id"] for r in rows])
    own = np.array([r["embedding"] for r in rows], float)
    units = own / np.linalg.norm(own, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % modulus == 0):
        near = units @ units[q]
        near[q] = -2
        out[int(ids[q])] = [(near[c], int(ids[c])) for c in np.lexsort((ids, -near))[:k]]
    return out


def test_best_bins_come_first_and_all_leaves_come():
    rng = np.random.default_rng(3)
    rows = kmeans_tree.directions(rng.normal(size=(600, 8)))
    tree = kmeans_tree.Tree(rows, 20)
    assert set(tree.assign(rows)) <= set(range(tree.leaves))
    order = list(tree.best_first(rows[0]))
    assert sorted(order) == list(range(tree.leaves))
    place = [list(tree.best_first(r)).index(leaf) for r, leaf in zip(rows[:100], tree.assign(rows[:100]), strict=True)]
    assert np.mean(place) < 0.1 * tree.leaves  # a row's own leaf is among the first
    truth = [(q, int(leaf)) for q, leaf in enumerate(tree.assign(rows[:100]))]
    needed = sorted(p + 1 for p in place)
    assert kmeans_tree.calibrated_visits(tree, rows[:100], truth, 1.0) == needed[-1]
    assert kmeans_tree.calibrated_visits(tree, rows[:100], truth, 0.5) == needed[49]
    assert kmeans_tree.Tree(np.ones((50, 4)), 5).leaves == 1


def test_a_vector_that_a_third_of_the_rows_share(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).tolist(), i % 2) for i in range(900)]
    index = kmeans_tree.Index(_frame(spark, rows), leaf_rows=1.0)
    found = index.search(F.col("id") % 30 == 0, 5, index.tree.leaves, block_rows=50, block_queries=10).orderBy("query_id", "rank").collect()
    first = [i for i in range(0, 900, 3)]
    for q in range(0, 900, 30):
        assert [r["vec_id"] for r in found if r["query_id"] == q] == [i for i in first if i != q][:5]


def _mined(rows, modulus, positives=5, negatives=10, low=30, high=90):
    rows = [(vectors.NO_ID if r["vec_id"] is None else r["vec_id"], [int(np.floor(256 * float(x))) for x in r["embedding"]], r["label"]) for r in rows if r["label"] is not None]
    out = []
    for a, (anchor, av, al) in enumerate(rows):
        if anchor == vectors.NO_ID or anchor % modulus:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v, strict=True)), i, label) for r, (i, v, label) in enumerate(rows) if r != a)
        for ps, p, _ in [s for s in scored if s[2] == al][:positives]:
            window = [s for s in scored if s[2] != al and low * -ps <= 100 * -s[0] <= high * -ps][:negatives]
            out += [(anchor, None if p == vectors.NO_ID else p, k, None if n == vectors.NO_ID else n, -ps, -ns) for k, (ns, n, _) in enumerate(window, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard_rows", "chunk"), [(hard_negatives.SHARD_ROWS, hard_negatives.CHUNK), (7, 4), (1, 1)])
def test_hard_negatives_against_brute_force(odd, shard_rows, chunk):
    """However few rows and dimensions meet at a time; zero vectors, ties, repeated ids and null ids included."""
    found = hard_negatives.hard_negatives(odd, F.col("id") % 5 == 0, shard_rows=shard_rows, chunk=chunk)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = _mined(_usable(odd.collect(), True), 5)
    assert len(expected) > 50
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected


def test_hard_negatives_of_a_wide_window_and_no_rows(odd):
    found = hard_negatives.hard_negatives(odd, F.col("id") % 5 == 0, low=-100, high=100, negatives=3, positives=2)
    assert sorted((tuple(r) for r in found.collect()), key=str) == _mined(_usable(odd.collect(), True), 5, 2, 3, -100, 100)
    assert hard_negatives.hard_negatives(odd.where("false"), F.col("id") % 5 == 0).count() == 0
    assert hard_negatives.hard_negatives(odd, F.col("id") == -1).count() == 0


def test_scores_beyond_64_bits(spark):
    df = _frame(spark, [(0, [1e15, 1.0], 0), (1, [1.0, 1.0], 1)])
    with pytest.raises(ValueError, match="64-bit"):
        hard_negatives.hard_negatives(df, F.col("id") == 0)
    big = _frame(spark, [(i, [float(2**17 + i), float(i)], i % 2) for i in range(12)])  # beyond exact doubles, within 64 bits
    found = hard_negatives.hard_negatives(big, F.col("id") % 5 == 0, high=101)
    assert sorted((tuple(r) for r in found.collect()), key=str) == _mined(big.collect(), 5, high=101)
