"""Forms of operators that no group of a table may slow down, against plain ones."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.functions import lexicon
from lintel.operators import panel, runs, selection, transcript
from lintel.sources import readers, writers
from lintel.streaming import progress


def _plain_throttle(rows, interval):
    shown, last = [], {}
    for stage, seq, now, force in sorted(rows):
        if force or now - last.get(stage, 0.0) >= interval:
            last[stage] = now
            shown.append((stage, seq))
    return shown


@pytest.mark.parametrize("forced", [0.0, 0.01])
def test_throttling_by_stretches(spark, forced):
    """One stage holds most rows and goes on over many partitions."""
    rng = np.random.default_rng(7)
    rows = []
    for stage, n in (("a", 3), ("b", 4000), ("c", 50), ("d", 1)):
        now = np.cumsum(rng.exponential(1.0, n)) + 5.0
        rows += [(stage, i, float(t), bool(rng.random() < forced)) for i, t in enumerate(now)]
    schema = "stage string, seq long, now double, force boolean"
    updates = spark.createDataFrame(rows, schema).selectExpr("*", "CAST(seq AS DOUBLE) AS completed", "4000.0D AS total")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = progress.throttled(updates, 4.0).select("stage", "seq", "now", "elapsed", "percent").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted((r["stage"], r["seq"]) for r in out) == _plain_throttle(rows, 4.0)
    starts = {s: min(t for x, _, t, _ in rows if x == s) for s in "abcd"}
    assert all(abs(r["elapsed"] - (r["now"] - starts[r["stage"]])) < 1e-9 and r["percent"] == 100.0 * r["seq"] / 4000 for r in out)
    assert progress.throttled(updates.limit(0), 4.0).count() == 0


def test_throttling_of_a_dense_stage_by_rows(spark):
    """Updates far closer than the interval, some forced, at times that sums do not hit, with totals missing: against a loop."""
    rng = np.random.default_rng(11)
    rows, expected, first, last = [], [], None, 0.0
    for i in range(3000):
        now, force = 7.0 + i * 0.1, bool(rng.random() < 0.02)
        completed, total = [(float(i), 3000.0), (None, 3000.0), (float(i), None), (-1.0, 5.0), (9.0, 5.0), (1.0, 0.0)][i % 6]
        rows.append(("a", i, now, completed, total, force))
        first = now if first is None else first
        if force or now - last >= 0.7:
            last = now
            done = min(max(completed, 0.0), total) if completed is not None and total else None
            percent = None if done is None else 100.0 * done / total
            eta = (now - first) * (total - done) / done if done and done < total else None
            expected.append((i, percent, now - first, eta))
    updates = spark.createDataFrame(rows, "stage string, seq long, now double, completed double, total double, force boolean")
    out = progress.throttled(updates, 0.7).orderBy("seq").collect()
    assert [(r["seq"], r["percent"], r["elapsed"], r["eta"]) for r in out] == expected


def test_descendants_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 8), (None, 5), (4, None)], "p int, c int")
    roots = spark.createDataFrame([(1,)], "c int")
    assert {r[0] for r in runs.descendants(edges, "p", "c", roots).collect()} == {1, 2, 3, 4, None}
    assert runs.descendants(edges, "p", "c", spark.createDataFrame([(9,)], "c int")).count() == 0


def test_rates_of_each_date_once(spark):
    rates = spark.createDataFrame([("2024-01-01", "USD", 1.1), ("2024-01-03", "USD", 1.2), ("2024-01-02", "EUR", 1.0)], "d string, currency string, rate double").selectExpr("CAST(d AS DATE) AS rate_date", "currency", "rate")
    probes = [("2024-01-02", "EUR", "USD")] * 3 + [("2024-01-05", "EUR", "USD"), ("2023-01-01", "EUR", "USD"), ("2024-01-05", None, "USD")]
    rows = spark.createDataFrame(probes, "d string, b string, t string").withColumn("d", F.col("d").cast("date"))
    out = [r["rate"] for r in panel.cross_rates(rows, rates, "d", "b", "t").orderBy("d", "b").collect()]
    assert out == [None, 1.1, 1.1, 1.1, None, 1.2]


def test_formats_by_name(spark):
    segments = spark.createDataFrame([(1, 0, "A", 0.0, 1.0, "hi"), (1, 1, "B", 1.0, 2.0, "you")], "k int, seg_no int, speaker string, start double, end double, text string")
    shown = {style: transcript.transcript_in(segments, ["k"], style).first()["out"] for style in transcript.FORMATS}
    assert shown["txt"] == "hi\nyou" and shown["vtt"].startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nhi")
    with pytest.raises(ValueError, match="unknown format"):
        transcript.transcript_in(segments, ["k"], "doc")
    whole = spark.createDataFrame([(1, " all "), (2, " all ")], "k int, whole string")
    assert {tuple(r) for r in transcript.text_of_each(segments, ["k"], whole).collect()} == {(1, "hi\nyou"), (2, "all")}


def test_models_go_out_and_come_back(spark, tmp_path):
    path = str(tmp_path / "model.json")
    (tmp_path / "model.json").write_text(json.dumps({"weights": {"title": 0.5, "other": 9}, "template_weights": {"work": 1}}))
    model = readers.training_model(spark, path)
    row = model.first()
    assert row["weights"] == {**lexicon.FEATURE_WEIGHTS, "title": 0.5} and row["template_weights"] == {**lexicon.TEMPLATE_WEIGHTS, "work": 1.0}
    writers.write_model(model, str(tmp_path / "again.json"))
    assert readers.training_model(spark, str(tmp_path / "again.json")).first() == row
    assert readers.training_model(spark).first()["weights"] == lexicon.FEATURE_WEIGHTS


def test_choices_and_tops(spark):
    rows = spark.createDataFrame([(1, "x", "A"), (2, "y", "A"), (3, "x", "B"), (4, None, "P"), (5, "z", None)], "pos int, id string, status string")
    out = selection.standing_choices(rows, "id", "pos", F.col("status").isin("A", "B")).collect()
    assert sorted(tuple(r) for r in out) == [("x", 1, 2), ("y", 2, 2), ("z", 5, 2)][:2]
    top = selection.most_frequent(rows.where("id IS NOT NULL"), "id", "pos", "status", 2).collect()
    assert [tuple(r) for r in top] == [("x", 2, "A"), ("y", 1, "A")]
    titles = spark.createDataFrame([("abc",), ("1999",), (" long enough ",), (None,), ("Related Articles here",)], "t string")
    assert [r[0] for r in titles.where(selection.names_work(F.col("t"))).collect()] == [" long enough "]
