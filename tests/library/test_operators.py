"""Operators against small brute-force versions and literal cases."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lintel.functions import lexicon, text, values
from lintel.operators import coverage, documents, linkage, panel, transcript
from lintel.plans import linkage_plans
from lintel.plans.tables import fixture
from lintel.sources import readers, writers
from lintel.streaming import progress


def _column(spark, make, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_fold_equals_decomposition(spark):
    rng = random.Random(1)
    inputs = ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x1E00, 0x2200), rng.randrange(0xFB00, 0xFB10)])) for _ in range(20)) for _ in range(100)]
    inputs = [s for s in inputs if "\x7f" not in s]
    assert _column(spark, text.fold_ascii, inputs) == [unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode() for s in inputs]


def test_normalize_joins_around_wide_dashes(spark):
    assert _column(spark, text.normalize, ["1–5", "a-b & c/d", "Café “x”", None, " A.B "]) == ["15", "a b c d", "cafe x", "", "a b"]


def test_natural_key(spark):
    names = ["b10", "b9", "a2", "B1", "b09a", "10", "9"]
    keys = dict(zip(names, _column(spark, text.natural_key, names), strict=True))
    assert sorted(names, key=lambda n: (keys[n], n)) == ["9", "10", "a2", "B1", "b9", "b09a", "b10"]


def test_score_of_a_full_match(spark):
    album = ("a", "Great Works 1", [], ["Ann Author"], ["Bea Player"], ["City Ensemble Nova"], "Cy Leader", ["piano"], "Label One", "2020")
    hit = ("h", "Great Works 1 piano Ann Author", ["Bea Player", "City Ensemble Nova", "Cy Leader"], "2020-01-01", "(C) Label One")
    pair = fixture(spark, linkage.ALBUM, [album]).crossJoin(fixture(spark, linkage.HIT, [hit]))
    row = linkage.scores(linkage.features(pair)).first()
    assert [row[f"{f}_score"] for f in linkage.FEATURES if f != "title"] == [1.0] * 7 and row["title_score"] >= 0.95
    assert row["score"] == pytest.approx(sum(w * row[f"{f}_score"] for f, w in lexicon.FEATURE_WEIGHTS.items()))


def _greedy(rows, most):
    """Selection in loops: (pos, template, query, weight key) per album."""
    if len(rows) <= most:
        return [r[2] for r in rows]

    def fam(t):
        return next((f for f in ("performer", "ensemble", "composer", "conductor", "instrument", "label", "work") if t.startswith(f)), "title")

    def key(r):
        w = lexicon.TEMPLATE_WEIGHTS.get(r[1], 0.5) * (1.5 if r[1].startswith("performer") else 1)
        return (-w, abs(r[3] - 5), len(r[2]), r[0])

    order, out = sorted(rows, key=key), []
    for name, cap in lexicon.FAMILY_CAPS.items():
        for r in order:
            mine = [x for x in out if fam(x[1]) == name]
            if len(out) < most and len(mine) < cap and fam(r[1]) == name and sum(x[1] == r[1] for x in mine) < lexicon.TEMPLATE_CAPS.get(r[1], 99):
                out.append(r)
    return [r[2] for r in (out + [r for r in order if r not in out])[:most]]


def test_selection_equals_greedy(spark):
    found = linkage.query_candidates(fixture(spark, linkage.ALBUM, linkage_plans.ALBUMS)).withColumn("n", F.size(text.split_tokens(F.col("query"))))
    by_album = {}
    for r in found.orderBy("album_id", "pos").collect():
        by_album.setdefault(r["album_id"], []).append((r["pos"], r["template"], r["query"], r["n"]))
    for most in (3, 12, 25):
        chosen = {}
        for r in linkage.select_queries(found, most).orderBy("album_id", "place").collect():
            chosen.setdefault(r["album_id"], []).append(r["query"])
        assert chosen == {a: _greedy(rows, most) for a, rows in by_album.items()}


def test_retrieval_orders_by_first_sighting(spark):
    queries = fixture(spark, "album_id string, place int, query string", [("a", 1, "q1"), ("a", 2, "q2")])
    index = fixture(spark, "query string, pos int, id string", [("q1", 0, "x"), ("q1", 1, "y"), ("q1", 2, "x"), ("q1", 3, "z"), ("q2", 0, "y")])
    out = {r["id"]: (tuple(r["first_seen"]), r["queries"]) for r in linkage.retrieve(queries, index, 2).collect()}
    assert out == {"x": ((1, 0), ["q1"]), "y": ((1, 1), ["q1", "q2"])}


def test_coverage_stops_at_budget(spark):
    candidates = fixture(spark, "album_id string, pos int, template string, query string", [("a", 0, "title", "ta"), ("a", 1, "work", "wa"), ("b", 0, "title", "tb")])
    index = fixture(spark, "query string, pos int, id string", [("wa", 0, "1"), ("tb", 0, "9")])
    truth = fixture(spark, "album_id string, truth_id string", [("a", "1"), ("b", "2")])
    out = coverage.train_coverage(candidates, index, truth, lexicon.TEMPLATE_WEIGHTS, iterations=2, calls=6)
    assert (out.covered, out.total) == (1, 2) and out.calls <= 6 and out.stats["work"][1] == 1


def test_emitters_on_blank_segments(spark):
    rows = [("a", 0, 0.0, 1.0, " Hello ", "S0"), ("a", 1, 1.0, 2.0, " ", "S1"), ("a", 2, 2.0, 3.0, "again", "S0"), ("a", 3, 3.0, 4.0, "Hi", None), ("b", 0, 0.0, 1.0, " ", None)]
    segments = spark.createDataFrame(rows, "conv string, seg_no int, start double, end double, text string, speaker string")
    one = lambda df: {r["conv"]: r["out"] for r in df.collect()}
    assert one(transcript.diarized_text(segments, ["conv"])) == {"a": "S0: Hello again\nHi"}
    assert one(transcript.diarized_breaks(segments, ["conv"]))["a"] == f"Hello again\n{transcript.BREAK}\nHi"
    assert one(transcript.legacy_breaks(segments, ["conv"]))["a"].count(transcript.BREAK) == 3
    assert one(transcript.subtitles(segments, ["conv"], "vtt"))["b"] == "WEBVTT"


def test_as_of_without_an_earlier_value(spark):
    left = fixture(spark, "k string, day date", [("a", "2024-01-01"), ("a", "2024-01-03"), ("b", "2024-01-03")])
    right = fixture(spark, "k string, at date, v double", [("a", "2024-01-02", 1.0), ("a", "2024-01-03", 2.0)])
    out = {(r["k"], str(r["day"])): r["v"] for r in panel.as_of(left, right, ["k"], "day", "at", "v").collect()}
    assert out == {("a", "2024-01-01"): None, ("a", "2024-01-03"): 2.0, ("b", "2024-01-03"): None}


def test_bad_page_range_raises(spark):
    with pytest.raises(Exception, match="Invalid page range"):
        documents.checked_page_lists(fixture(spark, "spec string, page_count int", [("4-2", 5)])).collect()


def test_sections_keep_fences(spark):
    lines = fixture(spark, "file string, line_no int, line string", [("f", i, s) for i, s in enumerate(["## A", "````", "## x", "```", "````", "## A"])])
    out = {r["file_name"]: r["content"] for r in documents.section_files(documents.fenced_sections(lines, "file"), "file").collect()}
    assert out == {"A": "## A\n````\n## x\n```\n````\n", "A 2": "## A\n"}


def test_throttle_on_a_stream_equals_the_table(spark, tmp_path):
    schema = "stage string, seq long, now double, completed double, total double, force boolean"
    rows = [(s, i, i * 0.7 + 1, float(i), 10.0, i == 4) for s in "ab" for i in range(12)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = progress.throttled(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2.0)
    query = stream.writeStream.format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    table = progress.throttled(spark.createDataFrame(rows, schema), 2.0)
    key = lambda df: sorted((r["stage"], r["seq"], r["percent"]) for r in df.collect())
    assert key(spark.table("shown")) == key(table) and 0 < table.count() < len(rows)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<gesmes:Envelope xmlns:gesmes="g"><Cube><Cube time="2024-01-02"><Cube currency="USD" rate="1.1"/><Cube currency="BAD" rate="x"/></Cube></Cube></gesmes:Envelope>')
    assert {(str(r[0]), r[1], r[2]) for r in readers.daily_rates(spark, str(tmp_path / "r.xml")).collect()} == {("2024-01-02", "USD", 1.1), ("2024-01-02", "EUR", 1.0)}
    (tmp_path / "t.txt").write_text("# c\nTicker,Name\nABC, x\nDEF y\nABC\n")
    assert [r["ticker"] for r in readers.tickers(readers.numbered_lines(spark, str(tmp_path / "t.txt"))).orderBy("line_no").collect()] == ["ABC", "DEF"]
    (tmp_path / "a.json").write_text('{"albums": [{"source": {"file": "f"}, "album": {"title": "T", "works": ["w"]}}, {"title": "Flat"}, 3]}')
    assert [r["album"]["title"] for r in readers.albums(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == ["T", "Flat"]
    record = '[{"record_id": "r", "album": {"title": "A"}, "choice": {"status": "selected", "catalogue_id": " "}, "chosen": {"id": "7", "title": ""}}, {"record_id": "r", "album": {"title": "B"}, "choice": {"catalogue_id": "9"}}]'
    (tmp_path / "t.json").write_text(record)
    records = readers.truth_records(spark, str(tmp_path / "t.json"), "catalogue_id")
    assert [tuple(r) for r in readers.chosen_ids(records, "catalogue_id").collect()] == [("r", "9", "B")]
    cut_off = spark.createDataFrame([(1, '[{"a": 1}, {"b": 2}, {"c"'), (2, "no")], "k int, raw string")
    assert [r["item"] for r in readers.truncated_items(cut_off, "k", "raw").orderBy("pos").collect()] == ['{"a": 1}', '{"b": 2}']
    out = spark.createDataFrame([(2, "é", None), (1, "x", 1.0)], "pos int, name string, v double")
    assert writers.export_array(out, str(tmp_path / "o.json"), "pos") == 2
    assert (tmp_path / "o.json").read_text().startswith('[\n  {\n    "name": "x"')
    items = fixture(spark, "k string, pos int, id string", [("a", i, str(i % 3)) for i in range(6)])
    assert [r["ids"] for r in writers.request_batches(items, ["k"], "id", "pos", 2).orderBy("batch").collect()] == [["0", "1"], ["2"]]
    weights = spark.range(1).select(readers.overlaid({"a": 1.0, "b": 2.0}, text.lookup({"b": 5.0, "z": 9.0})).alias("w")).first()["w"]
    assert weights == {"a": 1.0, "b": 5.0}


def test_durations(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (float("inf"),), (61.5,), (3661.0,)], "s double")
    assert [r[0] for r in df.select(values.duration(F.col("s"))).collect()] == ["unknown", "unknown", "unknown", "01:01", "1:01:01"]


def test_heading_parts(spark):
    lines = ["## **Bach; Handel** Suites – live", "### J S BACH Goldberg Variations", "## Plain title", "## **Only**"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, x string")
    rows = df.select(text.heading_people(F.col("x")).alias("p"), text.heading_title(F.col("x"), F.lit("fallback")).alias("t"), "i").orderBy("i").collect()
    assert [(r["p"], r["t"]) for r in rows] == [(["Bach", "Handel"], "Suites – live"), (["J S BACH"], "Goldberg Variations"), ([], "Plain title"), (["Only"], "fallback")]


def test_slug_and_instrument_words(spark):
    df = spark.range(1)
    row = df.select(
        text.slug_phrases(F.lit("bach-goldberg-variations"), F.array(F.lit("Bach"))).alias("slug"),
        text.without_instruments(F.lit("Ann Lee pf, Bo vn"), F.array(F.lit("piano"))).alias("rest"),
        text.unlike(F.array(F.lit("A b"), F.lit("C"), F.lit("c")), F.lit("a B!"), F.lit(None).cast("string")).alias("kept"),
    ).first()
    assert row["slug"] == ["bach goldberg variations", "goldberg variations"] and row["rest"] == "Ann Lee Bo vn" and row["kept"] == ["C"]


def test_heading_hints(spark):
    rows = [
        ("f", 1, "h2", "Work One", False), ("f", 2, "p", "", False), ("f", 3, "p", "Player A", True), ("f", 4, "p", "prose", False), ("f", 5, "p", "Label: Big", False),
        ("f", 6, "h3", "Work Two", False), ("f", 7, "p", "Player B (Small Label)", True), ("f", 8, "hr", "", False), ("f", 9, "p", "(Lost)", False),
        ("f", 10, "h2", "Work Three", False), *[("f", 11 + k, "p", f"line {k}", False) for k in range(5)], ("f", 16, "p", "too far (Label)", True),
        ("f", 17, "h2", "Related Articles", False), ("f", 18, "h2", "Work Four", False),
    ]
    out = documents.heading_hints(spark.createDataFrame(rows, "file string, pos int, tag string, text string, emphasised boolean"), "file")
    found = {r["title"]: (r["performer"], r["label"]) for r in out.collect()}
    assert found == {"Work One": ("Player A", "Big"), "Work Two": ("Player B", "Small Label"), "Work Three": (None, None)}


def test_performer_parts(spark):
    from lintel.operators.people import performer_parts

    cases = {
        "a": ("**Anna Prohaska** _sop_ **BBC Symphony Orchestra / Simon Rattle** (Harmonia Mundi)", "", (["Anna Prohaska"], ["BBC Symphony Orchestra"], "Simon Rattle", ["soprano"], "Harmonia Mundi")),
        "b": ("Lee & Ray; City Quartet", "Label: Big (Label)", (["Lee", "Ray"], ["City Quartet"], "", [], "Big (Label")),
        "c": ("Nova Players / Jo Fox, Al Dee", "", ([], ["Nova Players"], "Jo Fox; Al Dee", [], "")),
        "d": ("", "(Only Label)", ([], [], "", [], "Only Label")),
        "e": ("Mary Major _pf_ (L)", "", (["Mary Major"], [], "", ["piano"], "L")),
    }
    df = spark.createDataFrame([(k, p, lab) for k, (p, lab, _) in cases.items()], "k string, performer_line string, label_line string")
    out = {r["k"]: (r["performers"], r["ensembles"], r["conductor"], r["instruments"], r["label"]) for r in performer_parts(df, "k").collect()}
    assert out == {k: v for k, (_, _, v) in cases.items()}


def test_sections_of_many_files_share_batches(spark):
    """A Python group for each file took most of the time: lines come together in rows, and batches hold many of them."""
    lines = [(f"f{k}", i, line) for k in range(40) for i, line in enumerate(["pre", f"## A{k}", "```", "## not", "```", "## B ##", "end"])]
    found = documents.fenced_sections(spark.createDataFrame(lines[::-1], "file string, line_no int, line string"), "file")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    wanted = [(f, i, s, 0 if i < 1 else 1 if i < 5 else 2, "" if i < 1 else f"A{f[1:]}" if i < 5 else "B") for f, i, s in lines]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_folding_computes_a_text_once(spark):
    """The text to fold stood in the expression many times over; what each character becomes is as before."""
    rows = spark.createDataFrame([(f"Ab {chr(c)}x ’{chr(c)}½",) for c in range(0x20, 0x2FFF, 7)] + [("ﬁ…é “Ω”",), ("",), (None,)], "t string")
    once = rows.select("t", text.normalize(F.concat("t", F.lit("!"))).alias("n"))
    assert once._jdf.queryExecution().analyzed().toString().count("concat(") == 1
    for r in once.collect():
        plain = r["t"] or ""
        for mark in "’‘“”":
            plain = plain.replace(mark, " ")
        plain = unicodedata.normalize("NFKD", plain).encode("ascii", "ignore").decode().lower()
        assert r["n"] == " ".join(re.findall("[a-z0-9]+", plain))


def test_queries_are_selected_in_their_rows(spark):
    albums = fixture(spark, linkage.ALBUM, linkage_plans.ALBUMS)
    by_row = linkage.select_album_queries(linkage.album_queries(albums), 12)
    plan = by_row._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan  # no task holds the queries of many albums
    by_queries = linkage.select_queries(linkage.query_candidates(albums), 12)
    assert sorted(map(tuple, by_row.collect())) == sorted(map(tuple, by_queries.collect()))


def test_sides_of_pairs_are_prepared_before_they_meet(spark):
    albums, hits = fixture(spark, linkage.ALBUM, linkage_plans.ALBUMS), fixture(spark, linkage.HIT, linkage_plans.HITS)
    apart = linkage.features(linkage.album_features(albums).crossJoin(linkage.hit_features(hits)))
    together = linkage.features(albums.crossJoin(hits))
    scored = lambda df: sorted(map(tuple, linkage.scores(df).select("album_id", "id", *[f"{f}_score" for f in linkage.FEATURES], "score").collect()))
    assert scored(apart) == scored(together)


def test_grams_are_looked_up_without_frames(spark):
    docs = spark.createDataFrame([(k, ["a", "b", "c", "d", str(k)] if k % 3 else None) for k in range(700)], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([("a b c d",), ("b c d 7",)], "query string")
    found = linkage.held_grams(docs, asked)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()  # no frame of a whole batch's words
    assert sorted(map(tuple, found.collect())) == sorted([(k, "a b c d") for k in range(700) if k % 3] + [(7, "b c d 7")])
