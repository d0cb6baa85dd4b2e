"""Records, JSON values and candidates, by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from lintel.functions import json_values
from lintel.operators import candidates, records
from lintel.plans import record_plans, registry

SF = "/root/testdata/sf0.001"


def _rows(spark, name):
    return {tuple(r) for r in registry.queries()[name](spark, SF).collect()}


def test_plain_candidates(spark):
    rows = registry.queries()["plain_candidates"](spark, SF).collect()
    found = {(r["line_no"], r["title_hint"], r["performer_hint"], r["label_hint"]) for r in rows if r["file"] == "p-7"}
    assert len(rows) == 3 * 200  # every document is a file
    assert found == {
        (4, "BACH Goldberg Variations", "Vienna Philharmonic / Carlos Kleiber", "Sony Classical"),  # the later copy of it is the same
        (11, "MAHLER Symphony No 2", "Anna Prohaska sop", "Big Label"),
        (12, "Anna Prohaska sop", "", "Big Label"),
    }


def test_files_with_blocks_have_no_plain_candidates(spark):
    found = registry.queries()["file_candidates"](spark, SF).groupBy("file").count().collect()
    assert {r["file"] for r in found} == {f"{kind}-{k}" for kind in "mp" for k in range(200)}
    lines = spark.createDataFrame(record_plans.PLAIN_LINES, "file string, line_no int, line string")
    block = spark.createDataFrame([("p", 0, 1, "A title", "Someone", "")], "file string, block int, line_no int, title string, performer string, label string")
    only = candidates.markdown_candidates(block, lines).collect()
    assert [(r["file"], r["title_hint"], r["performer_hint"]) for r in only] == [("p", "A title", "Someone")]


def test_unknown_files_raise(spark):
    files = spark.createDataFrame([("a.MHT",), ("b.md",)], "file string")
    assert [r[0] for r in files.select(candidates.file_kind(F.col("file"))).collect()] == ["mail", "markdown"]
    with pytest.raises(Exception, match="Unsupported file extension"):
        spark.createDataFrame([("c.txt",)], "file string").select(candidates.file_kind(F.col("file"))).collect()


def test_plain_performers(spark):
    assert {(r["pos"], r["performers"], r["ensembles"], r["conductor"], r["instruments"]) for r in registry.queries()["plain_performers"](spark, SF).where("pos < 7").collect()} == {
        (0, "Martha Argerich", "Berlin Philharmonic", "Claudio Abbado", "pf"),
        (1, "Anna Prohaska|Julius Drake|LSO", "Chorus", "", ""),
        (2, "Smith|Jones", "", "", "vn|va"),
        (3, "", "", "", ""),
        (4, "", "", "", ""),
        (5, "", "LPO / BBC Symphony Orchestra", "", ""),
        (6, "One|Two", "", "", ""),
    }


def test_album_entries(spark):
    found = {r["candidate"]: r for r in registry.queries()["album_entries"](spark, SF).collect()}
    bach = found["p-0:4"]
    assert (bach["title"], bach["ensembles"], bach["conductor"], bach["label"], bach["composers"]) == ("BACH Goldberg Variations", "Vienna Philharmonic", "Carlos Kleiber", "Sony Classical", "")
    assert found["p-0:12"]["composers"] == "Anna Prohaska" and found["p-0:12"]["works"] == "sop|Anna Prohaska sop"


def test_entries_fall_back_to_the_plain_line(spark):
    row = spark.createDataFrame([("f", 3, "Some work", "Smith vn Jones va", "", "", "(DG)", "", "", "", "k")], f"{candidates.CANDIDATE}, candidate string")
    entry = candidates.album_entries(row).select("album.*", "source.context").first()
    assert entry["title"] == "Some work" and entry["label"] == "DG" and entry["context"]["title_line"] == "Some work"
    assert entry["performers"] and entry["works"] == ["Some work"]


def test_a_bad_feature_value_names_its_key(spark):
    bad = spark.createDataFrame([('{"good": 1, "speed": "fast"}',)], "raw string").select(json_values.float_map(F.try_parse_json("raw")))
    with pytest.raises(Exception, match=r"features\[speed\] must be a number, got fast"):
        bad.collect()


def test_listing_goes_on_only_while_it_is_short(spark):
    rows = [("a", 0, ["1"], None), ("a", 1, ["1", "2"], None), ("b", 0, ["1"], 2), ("b", 1, ["3", "4"], 2), ("b", 2, ["5", "6", "7"], 2), ("c", 0, [], 3), ("c", 1, ["1"], 3), ("c", 2, ["2"], 3)]
    out = records.longest_listing(spark.createDataFrame(rows, "k string, source int, ids array<string>, expected int"), "k").collect()
    assert {r["k"]: r["ids"] for r in out} == {"a": ["1"], "b": ["3", "4"], "c": ["1"]}


def test_percent_rounds_the_binary_value(spark):
    values = [0.00125, -0.5, 0.123455, 0.0, 2.675 / 100]
    out = spark.createDataFrame([(v,) for v in values], "v double").select(records.percent_text(F.col("v"))).collect()
    assert [r[0] for r in out] == [f"{v * 100:+.2f}%" for v in values]


def test_minutes_do_not_hang_on_the_order_of_rows(spark):
    """600 times 0.1 second is a minute, which a sum of doubles just misses; signs, and values beyond decimals."""
    seconds = [("a", 0.1)] * 600 + [("b", -0.1)] * 600 + [("c", -0.5), ("c", None), ("d", 1e25), ("d", 60.0), ("e", None), ("f", 119.999999999)]
    rows = spark.createDataFrame(seconds, "k string, s double").repartition(7)
    found = {r["k"]: r["minutes"] for r in records.whole_minutes(rows.where("k <> 'd'"), ["k"], "s").collect()}
    assert found == {"a": 1, "b": -1, "c": -1, "e": None, "f": 1}
    assert records.whole_minutes(rows.where("k = 'd'").withColumn("s", F.col("s") / 1e6), ["k"], "s").first()["minutes"] == int((1e25 / 1e6 + 60 / 1e6) // 60)


def test_blocks_of_files_are_found_once(spark):
    plan = registry.queries()["file_candidates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Related (Reviews|News)" not in plan  # blocks are written, not found again for the files that have none


def test_candidates_of_entries_are_found_once(spark):
    plan = registry.queries()["album_entries"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert candidates.UNDERLINE not in plan


def test_minutes_of_values_that_nine_places_do_not_hold(spark):
    """Values just below a minute, or below zero, are not rounded to it; sums beyond a long are no error."""
    seconds = [("a", 59.9999999996), ("b", -1e-11), ("c", -0.0), ("d", 1e20)] + [("e", 1e18)] * 10
    found = {r["k"]: r["minutes"] for r in records.whole_minutes(spark.createDataFrame(seconds, "k string, s double"), ["k"], "s").collect()}
    assert found == {"a": 0, "b": -1, "c": 0, "d": int(1e20 / 60), "e": 10**19 // 60}
