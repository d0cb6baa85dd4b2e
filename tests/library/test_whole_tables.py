"""Queries over whole tables, against brute force where the rows reach beyond the first ids."""

import re

from pyspark.sql import functions as F

from lintel.operators import linkage, runs
from lintel.plans import registry

SF = "/root/testdata/sf0.01"


def _table(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def test_title_ngrams_of_every_part(spark):
    found = registry.queries()["title_ngrams"](spark, SF)
    titles = {(str(k), re.sub(r"\s+", " ", f"{n} {t}").strip()) for k, n, t in _table(spark, "part", "p_partkey", "p_name", "p_type")}
    assert {(r[0], r[1]) for r in found.where("template = 'title'").select("album_id", "query").collect()} == titles


def test_title_ngrams_are_told_apart_in_their_row(spark):
    plan = registry.queries()["title_ngrams"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan  # no task holds the queries of many albums


def test_queries_of_an_album_that_several_rows_name(spark):
    rows = [("a", "Blue Sea"), ("a", "blue sea"), ("b", "Red Sky"), (None, "X1 Y1"), (None, "x1 y1")]
    albums = spark.createDataFrame([(i, t, [], [], [], [], None, [], None, None) for i, t in rows], linkage.ALBUM)
    found = sorted((r["album_id"] or "", r["query"].lower()) for r in linkage.query_candidates(albums).collect())
    both = lambda i, a, b: [(i, f"{a} {b}"), (i, f"{b} {a}")]
    assert found == sorted(both("a", "blue", "sea") + both("b", "red", "sky") + both("", "x1", "y1"))


def test_phrase_overlap_of_every_pair(spark):
    found = {(r[0], r[1]): r[2] for r in registry.queries()["phrase_overlap"](spark, SF).collect()}
    rows = sorted(_table(spark, "part", "p_partkey", "p_brand", "p_name"))
    wanted = {}
    for i, (k, brand, name) in enumerate(rows):
        mine = [re.sub("[^a-z0-9]+", "", x.lower()) for x in name.split(" ")]
        for o, other, theirs in rows[i + 1 :]:
            if other == brand:
                held = [v for v in mine if any(v in t.lower() or t.lower() in v for t in theirs.split(" "))]
                wanted[k, o] = round(len(held) / len(mine), 9)
    assert found == wanted


def test_attribution_covers_every_user(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("user_id", F.col("user_id") + 195)
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = registry.queries()["overlap_attribution"](spark, str(tmp_path)).select("user_id", "seg_no").collect()
    assert sorted(map(tuple, found)) == sorted(tuple(r) for r in events.select("user_id", "event_id").collect())


def test_upsert_of_every_order(spark):
    found = [tuple(r) for r in registry.queries()["upsert_records"](spark, SF).select("pos", "id", "o_orderstatus").collect()]
    orders = sorted(_table(spark, "orders", "o_orderkey", "o_orderstatus"))
    changed = [k for k, _ in orders if k % 7 == 0]
    wanted = [(k, "N" if k in changed and k % 2 else s) for k, s in orders] + [(k + 1_000_000, "N") for k in changed if k % 2 == 0]
    assert sorted(found) == [(i + 1, *w) for i, w in enumerate(wanted)]


def test_numbers_need_no_single_partition(spark):
    rows = spark.createDataFrame([(None if k % 3 == 0 else k % 50, k) for k in range(1000)], "a int, b int")
    out = runs.numbered(rows, "n", F.col("a").asc_nulls_last(), F.col("b").desc())
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    wanted = sorted(((None if k % 3 == 0 else k % 50, k) for k in range(1000)), key=lambda r: (r[0] is None, r[0] or 0, -r[1]))
    assert [tuple(r) for r in out.orderBy("n").select("a", "b", "n").collect()] == [(*w, i + 1) for i, w in enumerate(wanted)]
    assert runs.numbered(rows.limit(0), "n", "b").count() == 0


def test_truth_does_not_come_from_the_search(spark, tmp_path):
    start = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    other = start.replace(" ", "-")  # the same words, and no containment: five such take all places of the search
    docs = [(k, other) for k in range(1, 6)] + [(6, f"xx{start}xx"), (7, start), (8, "bb, one two"), (9, "another text")]
    items = [(1, start), (2, "b, one"), (3, "no document has these words in it at all")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = registry.queries()["eval_regressions"](spark, str(tmp_path)).select("album_id", "truth_id", "rank").collect()
    assert sorted(map(tuple, rows)) == [(1, 6, 0), (2, 8, 0)]
    measured = registry.queries()["eval_metrics"](spark, str(tmp_path)).first()
    assert (measured["n"], measured["lost"], measured["precision_at_1"]) == (2, 2, 0.0)


def test_truths_of_the_benchmark(spark):
    docs, items = _table(spark, "documents", "doc_id", "text"), _table(spark, "benchmark", "item_id", "text")
    wanted = {}
    for item, text in items:
        if ids := [d for d, t in docs if t and text[:60] in t]:
            wanted[item] = min(ids)
    found = registry.queries()["eval_regressions"](spark, SF).select("album_id", "truth_id").collect()
    assert dict(map(tuple, found)) == wanted


def test_fingerprint_is_of_the_whole_text(spark, tmp_path):
    long = "the same forty characters begin both of these texts, "
    docs = [(1, long + "one", "en"), (2, long + "two", "en"), (3, long.upper() + "(one)", "en"), (4, long + "one", "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.queries()["fingerprint_dedupe"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 2, 4]


def test_formats_tell_whole_turns(spark):
    turns = {}
    for conv, turn, role, said in sorted(_table(spark, "conversations", "conv_id", "turn", "role", "text")):
        turns.setdefault(conv, []).append((role, said))

    def out(name):
        return {r["conv_id"]: r["out"] for r in registry.queries()[name](spark, SF).select("conv_id", "out").collect()}

    def text(said):
        return said.strip(" ")

    assert out("emit_txt") == {c: "\n".join(text(s) for _, s in rows) for c, rows in turns.items()}
    for name in ("emit_srt", "emit_vtt", "diarized_txt", "diarized_breaks", "legacy_breaks"):
        found = out(name)
        assert found.keys() == turns.keys()
        for conv, rows in turns.items():
            assert all(text(s) in found[conv] for _, s in rows), name
    last = out("emit_srt")
    for conv, rows in list(turns.items())[:50]:
        seconds = sum(len(s) for _, s in rows) / 15
        cue = last[conv].rsplit(" --> ", 1)[1][:12]
        hours, minutes, rest = cue.replace(",", ".").split(":")
        assert abs(int(hours) * 3600 + int(minutes) * 60 + float(rest) - seconds) < 0.002


def test_limits_of_the_search_cost_recall(spark, tmp_path):
    """Eight documents hold a passage, five of which a query keeps; one holds only its end, which the first queries miss."""
    words = [f"word{k}" for k in range(60)]
    passage = " ".join(words)
    docs = [(k, f"intro {passage} {k}") for k in range(8)] + [(8, f"only {' '.join(words[40:])}"), (9, "another text")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = registry.queries()["eval_recall"](spark, str(tmp_path)).first()
    assert (found["items"], found["pairs"], found["found"], found["lost"], found["in_first_5"]) == (1, 9, 5, 4, 5)
    assert (round(found["recall"], 6), round(found["recall_all_documents"], 6), found["recall_all_queries"]) == (round(5 / 9, 6), round(8 / 9, 6), 1.0)


def test_features_of_rows_that_share_a_key(spark):
    from lintel.operators import records

    rows = [("x", {"b": 0.25}), ("x", {"a": 0.5, "c": 0.0, "b": 0.125}), ("y", {}), ("z", None), (None, {"a": -1.0})]
    found = records.feature_text(spark.createDataFrame(rows, "k string, f map<string,double>"), "k", "f").collect()
    assert sorted((str(r["k"]), r["features"]) for r in found) == [("None", "(no signals)"), ("x", "a=0.50 b=0.12"), ("x", "b=0.25"), ("y", "(no signals)"), ("z", "(no signals)")]


def test_phrases_are_normalised_once_a_row(spark, monkeypatch):
    """Several blocks of a group, copies, rows without phrases; no pair carries a normalising expression."""
    from lintel.functions import text
    from lintel.operators import linkage

    monkeypatch.setattr(linkage, "BLOCK", 4)
    names = [["Red  Ring", "bolt"], ["ring"], [], None, ["", "x"], ["RED", "ring", "ring"], ["bolts", "xx"]]
    rows = spark.createDataFrame([(g, k, names[(k * k + k // 7) % 7]) for g in ("a", "b", None) for k in range(30)] + [("a", None, ["x"])], "g string, k long, names array<string>")
    found = linkage.phrase_pairs(rows, "g", "k", "names")
    plan = found._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan and "BroadcastNestedLoopJoin" not in plan
    a, b = rows.alias("a"), rows.alias("b")
    score = F.round(text.phrase_overlap(F.col("a.names"), F.col("b.names")), 9)
    wanted = a.join(b, F.expr("a.g = b.g AND a.k < b.k")).select("a.k", "b.k", score)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, wanted.collect())))


def test_pairs_of_copies_do_not_pass_python_one_by_one(spark):
    """Copies of few names: a row of Python stands for many pairs, and one that gives pairs stays bounded."""
    from lintel.functions import text
    from lintel.operators import linkage

    rows = spark.range(1_000).selectExpr("'g' AS g", "id * 3 AS k", "IF(id < 900, array('red', 'ring'), IF(id % 3 = 0, NULL, array(concat('r', id % 2), 'rings'))) AS names")
    blocks = linkage.phrase_blocks(rows, "g", "k", "names").cache()
    pairs = blocks.selectExpr("count(*)", "max(size(lefts))", "sum(size(lefts) * size(rights))").first()
    assert pairs[0] * 100 < 1_000 * 999 / 2 <= pairs[2] and pairs[1] == linkage.SPAN
    found = linkage.phrase_pairs(rows, "g", "k", "names")
    a, b = rows.alias("a"), rows.alias("b")
    score = F.round(text.phrase_overlap(F.col("a.names"), F.col("b.names")), 9).alias("score")
    wanted = a.join(b, F.expr("a.g = b.g AND a.k < b.k")).select(F.col("a.k").alias("left_key"), F.col("b.k").alias("right_key"), score)
    assert found.count() == 1_000 * 999 / 2 and found.exceptAll(wanted).isEmpty()
