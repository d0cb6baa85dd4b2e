"""Listings, saved responses, requests, plug-ins and the interval sweep against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lintel.functions.plugins import register_plugin
from lintel.operators import listings, transcript
from lintel.sources import responses, writers

PAGES = "link string, status int, items array<string>, next array<string>"


def _walk(pages, start, most=None):
    """Breadth first, each link asked once."""
    seen, front, order, depth = {start}, [start], [], 0
    while front and (most is None or depth <= most):
        ahead = []
        for link in front:
            if pages.get(link, (0,))[0] != 200:
                continue
            order.append((depth, link))
            ahead += [n for n in pages[link][2] if n is not None]
        front = list(dict.fromkeys(n for n in ahead if n not in seen))
        seen.update(front)
        depth += 1
    return order


@pytest.mark.parametrize("most", [None, 0, 1, 2])
def test_pages_are_followed_in_order(spark, most):
    """Cycles, missing pages, pages that fail, links that several pages name, listings that share pages, a start that is not there."""
    rng = random.Random(3)
    pages = {f"p{i}": (200 if i % 9 else 404, [rng.choice(["a", "b", None, f"i{i}"]) for _ in range(rng.randint(0, 4))], [rng.choice([f"p{rng.randint(0, 69)}", "gone", None]) for _ in range(rng.randint(0, 3))]) for i in range(60)}
    frame = spark.createDataFrame([(link, *rest) for link, rest in pages.items()], PAGES)
    starts = {k: f"p{k * 7 % 60}" for k in range(12)} | {77: "gone", 78: "p0"}
    read = listings.followed(frame, spark.createDataFrame(list(starts.items()), "listing long, link string"), most)
    got = {}
    for r in read.orderBy("listing", "depth", "place").collect():
        got.setdefault(r["listing"], []).append((r["depth"], r["link"]))
    expected = {k: order for k, link in starts.items() if (order := _walk(pages, link, most))}
    assert got == expected
    items = listings.listed_items(frame, read)
    said = {}
    for r in items.orderBy("listing", "depth", "place", "nth").collect():
        said.setdefault(r["listing"], []).append(r["item"])
    flat = {k: [i for _, link in order for i in pages[link][1] if i is not None] for k, order in expected.items()}
    assert said == {k: v for k, v in flat.items() if v}
    once = {r["listing"]: r["items"] for r in listings.in_order(listings.distinct_items(items), "depth", "place", "nth").collect()}
    assert once == {k: list(dict.fromkeys(v)) for k, v in flat.items() if v}


def test_no_pages_and_no_starts(spark):
    none = spark.createDataFrame([], PAGES)
    starts = spark.createDataFrame([(1, "x")], "listing long, link string")
    assert listings.followed(none, starts).count() == 0
    assert listings.followed(spark.createDataFrame([("x", 200, [], [])], PAGES), starts.limit(0)).count() == 0


def test_offsets_end_with_an_empty_page_or_the_total(spark):
    rows = [("a", 0, 200, ["1", "2"], None), ("a", 2, 200, ["3"], 9), ("a", 3, 200, [], 9), ("a", 5, 200, ["no"], 9)]
    rows += [("b", 0, 200, ["1", "2"], 3), ("b", 2, 200, ["3", "4"], 99), ("b", 4, 200, ["no"], 99), ("c", 0, 500, ["no"], 1), ("d", 0, 200, ["1"], None), ("d", 1, 404, ["no"], None)]
    pages = listings.offset_links(spark.createDataFrame(rows, "listing string, offset int, status int, items array<string>, total int"))
    starts = spark.createDataFrame([(x, f"{x}@0") for x in "abcd"], "listing string, link string")
    items = listings.listed_items(pages, listings.followed(pages, starts))
    assert {r["listing"]: r["items"] for r in listings.in_order(items, "depth", "place", "nth").collect()} == {"a": ["1", "2", "3"], "b": ["1", "2", "3", "4"], "d": ["1"]}


def test_the_last_response_about_a_track_counts(spark):
    said = [("t", 1, 200, ["x"]), ("t", 3, 200, ["y", "z"]), ("t", 4, 500, ["no"]), ("u", 1, 200, ["w"]), ("u", 2, 200, []), ("v", 1, 200, [None]), ("w", 1, 200, None)]
    items = [(1, 0, "t"), (1, 1, "u"), (1, 2, "t"), (1, 3, "v"), (2, 0, "w"), (2, 1, "gone"), (2, 2, None), (2, 3, "t")]
    found = listings.first_albums(spark.createDataFrame(items, "p int, pos int, track string"), spark.createDataFrame(said, "track string, response int, status int, albums array<string>"))
    assert sorted((r["p"], r["pos"], r["album"]) for r in found.collect()) == [(1, 0, "y"), (1, 2, "y"), (2, 3, "y")]


def test_groups_with_more_than_one_tuple_are_rejected(spark):
    rows = [("a", "aac", 44100, 2), ("a", "aac", 44100, 2), ("b", "aac", 44100, 2), ("b", "mp3", 44100, None), ("c", None, None, None), ("d", "aac", 1, 1), ("d", None, None, None), (None, "x", 1, 1)]
    frame = spark.createDataFrame(rows, "book string, codec string, rate int, channels int")
    groups, seen = listings.observed_rejections(listings.uniform_groups(frame, ["book"], ["codec", "rate", "channels"]))
    found = {r["book"]: (r["uniform"], r["rows"], r["variants"]) for r in groups.collect()}
    assert found == {"a": (True, 2, ["aac/44100/2"]), "b": (False, 2, ["aac/44100/2", "mp3/44100/-"]), "c": (False, 1, []), "d": (True, 2, ["aac/1/1"]), None: (True, 1, ["x/1/1"])}
    assert seen.get == {"groups": 5, "rejected": 2}
    good, bad = listings.rejected_last(frame, listings.uniform_groups(frame, ["book"], ["codec", "rate", "channels"]), ["book"])
    assert good.where("book = 'a'").count() == 2 and {r["book"] for r in bad.collect()} == {"b", "c"}


BODIES = [
    '{"request": "q1", "status": 200, "body": {"data": {"type": "searchResults", "relationships": {"albums": {"data": [{"type": "albums", "id": "2"}, {"type": "albums", "id": "9"}, {"type": "videos", "id": "1"}, {"type": "albums", "id": "1"}]}}},'
    ' "included": [{"type": "albums", "id": "1", "attributes": {"title": "One", "copyright": {"text": "c"}}, "relationships": {"artists": {"data": {"type": "artists", "id": "x"}}}}, {"type": "albums", "id": "2", "attributes": {"releaseDate": "2020"}}, {"type": "artists", "id": "x", "attributes": {"name": "X"}}]}}',
    '{"request": "a1", "status": 200, "body": {"data": {"type": "albums", "id": "1", "attributes": {"title": "One", "numberOfItems": 7}, "relationships": {"artists": {"data": [{"type": "artists", "id": "y"}, {"type": "artists", "id": "x"}]}}}, "included": [{"type": "artists", "id": "x", "attributes": {}}]}}',
    '{"request": "a2", "status": 404, "body": {}}',
    '{"request": "a3", "status": 200, "body": null}',
    '{"request": "a4", "status": 200, "body": {"data": null}}',
    '{"request": "a5"}',
    '{"request": "a6", "sta',
    "   ",
]


def test_saved_responses_and_their_failures(spark, tmp_path):
    (tmp_path / "saved.jsonl").write_text("\n".join(BODIES))
    read = responses.saved_responses(spark, str(tmp_path)).cache()
    assert {r["request"]: r["problem"] for r in read.where("problem IS NOT NULL").collect()} == {"a2": "status 404", "a3": "no body", "a5": "no status", None: "not JSON"}
    hits = [tuple(r) for r in responses.search_hits(read).orderBy("pos").collect()]
    assert hits == [("q1", 0, "2", "", "2020", [], ""), ("q1", 3, "1", "One", "", ["X"], '{"text":"c"}')]
    assert [tuple(r) for r in responses.search_hits(read, 2).collect()] == hits[:1]
    assert [tuple(r) for r in responses.album_details(read).collect()] == [("a1", "1", "One", "", [""], "", 7)]
    whole = tmp_path / "files"
    whole.mkdir()
    (whole / "one.json").write_text(json.dumps(json.loads(BODIES[1]), indent=2))
    assert responses.album_details(responses.saved_responses(spark, str(whole), lines=False)).count() == 1


def test_requests_are_committed_once(spark, tmp_path):
    folder = f"{tmp_path}/requests"
    bodies = spark.range(100).selectExpr("concat('b', id) AS body").repartition(5)
    responses.send(bodies, folder, "one")
    responses.send(bodies, folder, "one")  # a retry
    responses.send(bodies.limit(3), f"file://{folder}", "two")
    found = responses.sent(spark, folder).collect()
    assert sorted(r["body"] for r in found if r["job"] == "one") == sorted(f"b{i}" for i in range(100))
    assert sum(r["job"] == "two" for r in found) == 3
    broken = spark.range(20).repartition(4).selectExpr("CASE WHEN id = 7 THEN raise_error('broken') ELSE concat('x', id) END AS body")
    with pytest.raises(Exception, match="broken"):
        responses.send(broken, folder, "three")
    assert {r["job"] for r in responses.sent(spark, folder).collect()} == {"one", "two"}
    responses.send(spark.range(2).selectExpr("concat('x', id) AS body"), folder, "three")
    assert responses.sent(spark, folder).where("job = 'three'").count() == 2


def test_batches_of_a_key_of_any_size(spark):
    rows = [("hot" if i % 10 else "cold", f"i{i % 700}", i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k string, id string, o long")
    for distinct in (True, False):
        expected = {}
        for k, i, _ in rows:
            expected.setdefault(k, []).append(i)
        if distinct:
            expected = {k: list(dict.fromkeys(v)) for k, v in expected.items()}
        found = writers.request_batches(frame, ["k"], "id", "o", 50, distinct).collect()
        assert {(r["k"], r["batch"]): r["ids"] for r in found} == {(k, b): v[50 * b : 50 * b + 50] for k, v in expected.items() for b in range(-(-len(v) // 50))}


def test_plugins_are_called_from_sql(spark):
    def total(row, state):
        state["key"], state["sum"] = row["k"], state.get("sum", 0) + row["v"]
        if row["v"] % 2:
            yield row["k"], row["v"], state["sum"]

    def last(state):
        if state:
            yield state["key"], None, state["sum"]

    register_plugin(spark, "running", total, "k string, v long, total long", ["k"], ["v"], last)
    spark.createDataFrame([("a", 3), ("b", 2), ("a", 1), ("a", 2)], "k string, v long").createOrReplaceTempView("numbers")
    found = [tuple(r) for r in spark.sql("SELECT * FROM running(TABLE(numbers)) ORDER BY k, total, v NULLS LAST").collect()]
    assert found == [("a", 1, 1), ("a", 3, 6), ("a", None, 6), ("b", None, 2)]
    with pytest.raises(Exception, match="needs the columns v"):
        spark.sql("SELECT * FROM running(TABLE(SELECT k FROM numbers))").collect()
    with pytest.raises(Exception, match="takes a table"):
        spark.sql("SELECT * FROM running(5)").collect()
    assert spark.sql("SELECT * FROM running(TABLE(SELECT * FROM numbers WHERE v > 9))").count() == 0


@pytest.mark.parametrize("cell_rows", [4, 64, transcript.CELL_ROWS])
def test_sweep_against_all_pairs(spark, cell_rows):
    """One key holds most rows; long turns span many cells; ties, touching ends, empty and reversed intervals, a key without turns."""
    rng = random.Random(4)
    key = lambda i: "hot" if i % 5 else f"k{i % 3}"
    segments = [(key(i), i, s := rng.randint(0, 400) / 2, s + rng.choice([0.0, 0.5, 3.0, 8.0, 120.0, -1.0])) for i in range(300)] + [("alone", 1, 0.0, 9.0)]
    turns = [(key(i), i, s := rng.randint(0, 400) / 2, s + rng.choice([0.0, 1.0, 4.0, 4.0, 60.0, -2.0]), rng.choice(["A", "B", "C", None])) for i in range(200)]
    found = transcript.attributed(spark.createDataFrame(segments, "k string, seg_no int, start double, end double"), spark.createDataFrame(turns, "k string, turn_no int, start double, end double, speaker string"), ["k"], cell_rows)
    expected = {}
    for k, no, start, end in segments:
        best = min(((-(min(end, e) - max(start, s)), t, who) for q, t, s, e, who in turns if q == k and min(end, e) - max(start, s) > 0), default=(0, 0, None))
        expected[k, no] = best[2]
    assert {(r["k"], r["seg_no"]): r["speaker"] for r in found.collect()} == expected
    numbers = {}
    for k, no, _, _ in sorted(segments, key=lambda s: s[1]):
        if (who := expected[k, no]) is not None:
            numbers.setdefault(k, {}).setdefault(who, len(numbers.get(k, {})))
    assert {(r["k"], r["seg_no"]): r["label"] for r in found.collect()} == {(k, no): None if who is None else f"SPEAKER_{numbers[k][who]:02d}" for (k, no), who in expected.items()}


def test_sweep_without_rows(spark):
    segments = spark.createDataFrame([("a", 1, 0.0, 1.0)], "k string, seg_no int, start double, end double")
    turns = spark.createDataFrame([], "k string, turn_no int, start double, end double, speaker string")
    assert [r["speaker"] for r in transcript.attributed(segments, turns, ["k"]).collect()] == [None]
    assert transcript.attributed(segments.where(F.lit(False)), turns, ["k"]).count() == 0
