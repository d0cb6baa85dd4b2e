import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import components, exact_dedup, simhash


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("ranges", [1, 2, 8, 40])
def test_exact_duplicates_against_brute_force(odd_docs, ranges):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    out = exact_dedup.exact_duplicates(odd_docs, ranges=ranges).collect()
    assert len(out) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(_norm(t), []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in out:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
    for sha in by_sha:
        kept = [r for r in out if r["text_sha256"] == sha and r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == kept[0]["keep_id"]


def test_ranges_are_the_order_of_the_texts(small):
    """Ranges follow each other in the order of the bytes; the comparison with the neighbour finds the runs, and nothing else does."""
    docs, _, pdf, _ = small
    rows = exact_dedup.keyed_rows(docs, "doc_id", "text")
    splitters = exact_dedup.sampled_splitters(rows, 12)
    assert len(splitters) == 11
    dealt = rows.withColumn("range", exact_dedup.range_of(splitters, rows.schema)).collect()
    keys = sorted(((r["norm"].encode(), r["none"], r["id"], r["number"]), r["range"]) for r in dealt)
    assert [r for _, r in keys] == sorted(r["range"] for r in dealt)
    marks = [(s["norm"].encode(), s["none"], s["id"], s["number"]) for s in splitters]
    assert [r for _, r in keys] == [sum(m <= k for m in marks) for k, _ in keys]
    assert len({r for _, r in keys}) == 12
    runs = exact_dedup.content_runs(rows, 12)
    sizes = pdf["text"].map(_norm).value_counts()
    starts = runs.where("starts").count()
    across = exact_dedup.joined_runs(runs).where("NOT owns").count()
    assert starts - across == len(sizes)
    assert runs.where("opens").count() == runs.where("closes").count() == 12


def test_texts_with_one_digest_stay_apart(spark, monkeypatch):
    """The full comparison decides: with a digest that is the same for all texts the groups are right."""
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.lit("same"))
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string")
    out = exact_dedup.exact_duplicates(docs, ranges=3).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in out} == {(i, i % 7) for i in range(50)}


@pytest.mark.parametrize("text", ["one text", "a long text " * 60])
def test_a_text_of_a_third_of_all_rows_lies_across_ranges(spark, text):
    docs = spark.range(3000).selectExpr("id AS doc_id", f"CASE WHEN id % 3 = 0 THEN '{text}' ELSE concat('{text}', id) END AS text")
    docs = docs.unionAll(docs.where("doc_id = 6").selectExpr("CAST(NULL AS LONG)", "text"))
    runs = exact_dedup.content_runs(exact_dedup.keyed_rows(docs, "doc_id", "text"), 20)
    assert runs.groupBy("range").count().agg(F.max("count")).first()[0] < 600
    across = exact_dedup.joined_runs(runs).collect()
    assert len(across) >= 5 and {(r["group_id"], r["group_size"]) for r in across} == {(0, 1001)} and sum(r["owns"] for r in across) == 1
    out = exact_dedup.exact_duplicates(docs, ranges=20)
    assert out.where("kept").count() == 2001 and out.where("keep_id = 0 AND group_size = 1001").count() == 1001


def test_identifiers_that_are_strings(spark):
    docs = spark.createDataFrame([(x, "t") for x in ("b", "a", None, "c")] + [("d", "u")], "doc_id string, text string")
    out = {r["doc_id"]: tuple(r)[1:4] for r in exact_dedup.exact_duplicates(docs, ranges=4).collect()}
    assert out == {"a": ("a", 4, True), "b": ("a", 4, False), "c": ("a", 4, False), None: ("a", 4, False), "d": ("d", 1, True)}


def test_exact_duplicates_of_no_rows(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    assert exact_dedup.keep_one_of_each(no_docs).count() == 0


def test_exact_dedup_keeps_columns_and_one_row_of_each(odd_docs):
    kept = exact_dedup.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [_norm(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({_norm(r["text"]) for r in odd_docs.collect()})


def _components(ids, fps):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= simhash.RADIUS):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least.setdefault(find(i), []).append(ids[i])
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_near_duplicates_against_brute_force(small):
    docs, _, pdf, _ = small
    out = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = np.array([simhash.fingerprint(t) for t in pdf["text"]], np.uint64)
    assert [out[i]["fingerprint"] for i in pdf["doc_id"]] == [f"{int(f):016x}" for f in fps]
    assert [out[i]["component_id"] for i in pdf["doc_id"]] == _components(pdf["doc_id"].tolist(), fps)


def test_fingerprint_bits():
    import xxhash

    words = "The Quick brown fox jumps over the lazy dog".split()
    shingles = [" ".join(words[i : i + 4]).lower() for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    expected = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(" ".join(words)) == expected
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest("one two", 42)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    out = simhash.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    empty = [r["component_id"] for r in out if r["fingerprint"] == "0" * 16]
    assert empty == [0] * 4  # null, empty, blank, and null without an id
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one_of_each_component(odd_docs)
    assert kept.columns == odd_docs.columns
    by_component = {}
    for r in odd_docs.select("doc_id", "text").collect():
        by_component.setdefault(simhash.fingerprint(r["text"]), []).append(r["doc_id"])  # no two of these texts are near
    left = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in kept.collect()]
    assert sorted(left) == sorted((min(i for i in ids if i is not None), fp) for fp, ids in by_component.items())
    assert [i for i, _ in left].count(3) == 2  # two texts that share an id both stay


def test_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 2**63))
    fps = np.unique([base ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 7), replace=False)) for _ in range(600)])
    nodes = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    for bucket_rows in (10, 50, 200, 10_000):
        links = simhash.near_links(nodes, bucket_rows)
        roots = components.star_components(links).select("root").distinct().count()
        expected = _components(list(range(len(fps))), fps.astype(np.uint64))
        sizes = np.bincount(expected)
        assert roots == int((sizes > 1).sum())


def test_pivot_table_discards_no_link():
    """By reference: every pair within the radius survives; of random pairs hardly one does."""
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    close = fps ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in fps], np.uint64)
    both = np.concatenate([fps, close])
    pivots = simhash.pivot_distances(both)
    assert (pivots[7] == [int(p ^ both[7]).bit_count() for p in simhash._PIVOTS]).all()
    a = np.arange(2000)
    assert (simhash.pivot_survivors(pivots, a, a + 2000) == a).all()
    a, b = np.triu_indices(2000, 1)
    alive = simhash.pivot_survivors(pivots, a, b)
    assert (np.abs(pivots[a[alive]] - pivots[b[alive]]).max(1) <= simhash.RADIUS).all()
    assert len(alive) < 1e-3 * len(a)  # a reference lets about 0.6 of random pairs through


def test_a_third_of_all_links_at_one_node(spark):
    links = spark.range(1, 2001).selectExpr("id AS a", "0L AS b").unionAll(spark.range(3000, 4000).selectExpr("id AS a", "id + 1 AS b"))
    out = components.star_components(links).groupBy("root").count().collect()
    assert sorted(tuple(r) for r in out) == [(0, 2001), (3000, 1001)]


def test_star_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (7, 6), (6, 5)], "a long, b long")
    out = {r["node"]: r["root"] for r in components.star_components(links).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4}
    assert components.star_components(links.where(F.lit(False))).count() == 0
