import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lintel.llm import exact_dedup, quality_rules, simhash, toxicity

SF = "/root/testdata/sf0.001"


def _components(fps):
    """Component number of each fingerprint, by comparing all pairs."""
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= simhash.RADIUS).tolist():
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_run_against_brute_force(spark):
    """The documents that come out are those that the verdicts and a comparison of all pairs leave."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in quality_rules.judge_quality(docs, labels).where("kept").collect()}
    clean = {r["doc_id"] for r in toxicity.score_toxicity(docs.where(docs["doc_id"].isin(good)), labels).where("predicted = 0").collect()}
    assert 0 < len(clean) < len(good) < docs.count()
    first = {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        if r["doc_id"] in clean:
            first.setdefault(" ".join(r["text"].split()) if r["text"] == r["text"].strip() else r["text"], (r["doc_id"], r["text"]))
    rows = sorted(first.values())
    left = {}
    for (i, _), c in zip(rows, _components(np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)), strict=True):
        left.setdefault(c, i)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == set(left.values())


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.schema == docs.schema and 0 < out.count() <= before
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
        docs, before = out, out.count()


def test_stages_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Nulls, repeats, and columns whose names operators use inside, through every stage by Parquet."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality_rules.keep_good(docs, labels).where("lang = 'en'").orderBy(F.length("text").desc()).first()["text"]
    some = odd_docs.withColumn("text", F.when(F.col("doc_id") == 7, F.lit(kept)).otherwise(F.col("text")))
    for name, docs in (("odd", some), ("none", no_docs)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            path = str(tmp_path / f"{name}{k}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert {r["doc_id"] for r in packed.collect()} == ({7} if name == "odd" else set())


def test_verdicts_go_by_row(spark):
    """Of rows that share an id or have none, only the rejected ones go."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judge_quality(docs, labels).collect()}
    good, bad = min(i for i, k in verdict.items() if k), min(i for i, k in verdict.items() if not k)
    text = {r["doc_id"]: r["text"] for r in docs.where(docs["doc_id"].isin(good, bad)).collect()}
    odd = spark.createDataFrame([(-5, text[good]), (-5, text[bad]), (None, text[good]), (None, text[bad])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionAll(odd)
    left = [tuple(r) for r in corpus_pipeline.quality(spark, both, SF).where("doc_id IS NULL OR doc_id < 0").collect()]
    assert sorted(left, key=str) == sorted([(-5, text[good]), (None, text[good])], key=str)
    once = exact_dedup.keep_one_of_each(both.where("doc_id IS NULL OR doc_id < 0")).collect()
    assert sorted(r["doc_id"] for r in once) == [-5, -5]
