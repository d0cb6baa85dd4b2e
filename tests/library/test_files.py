"""Mails, kept searches and training on a table, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from lintel.functions import lexicon
from lintel.operators import candidates, documents, linkage
from lintel.plans import file_plans
from lintel.sources import readers

SF = "/root/testdata/sf0.001"


def test_elements_of_pages(spark):
    pages = [
        ("a", "<h2>One <b>two</b></h2><p>x<br>y<p><i> </i>z<hr>loose<h3>T</h3><div><p><em>e</em></div>tail<ul><li>l</ul>"),
        ("b", None), ("c", "no element"), ("d", "<p>open <strong>end"),
    ]
    found = documents.html_elements(spark.createDataFrame(pages, "file string, html string"), "file", "html").collect()
    by_page = {}
    for r in found:
        by_page.setdefault(r["file"], []).append((r["pos"], r["tag"], r["text"], r["emphasised"]))
    assert by_page["a"] == [(0, "h2", "One two", True), (1, "p", "xy", False), (2, "p", "z", False), (3, "hr", "", False), (4, "h3", "T", False), (5, "p", "e", True), (6, "li", "l", False)]
    assert by_page["d"] == [(0, "p", "open end", True)] and set(by_page) == {"a", "d"}


def test_archives_of_pages_as_files(spark, tmp_path):
    mail = file_plans.MAIL.replace("{w}", "Alpha").replace("{n}", "7")
    (tmp_path / "x.mhtml").write_text(mail, newline="")
    (tmp_path / "empty.mht").write_text("From: a\n\nno page")
    pages = {r["file"].rpartition("/")[2]: r["html"] for r in readers.mail_pages(spark, str(tmp_path)).collect()}
    assert pages["empty.mht"] is None and "<h2>Work Alpha 7</h2>" in pages["x.mhtml"]
    files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path AS file", "content")
    found = candidates.file_candidates(files).collect()
    assert {(r["title_hint"], r["performer_hint"], r["label_hint"]) for r in found} == {("Work Alpha 7", "Player Alpha", "House 7"), ("Second Alpha piece", "Band 7", "Small Alpha")}
    entry = candidates.album_entries(spark.createDataFrame([(*r, "k") for r in found if r["title_hint"] == "Work Alpha 7"], f"{candidates.CANDIDATE}, candidate string")).first()
    assert (entry["album"]["title"], entry["album"]["performers"], entry["album"]["label"]) == ("Work Alpha 7", ["Player Alpha"], "House 7")


def test_kept_entries_are_as_first_seen(spark):
    rows = [(1, 0, "a", "first", ["q", "p", ""]), (1, 1, "b", "other", ["q"]), (2, 0, "a", "second", ["q", "r"]), (2, 1, "c", None, None)]
    records = spark.createDataFrame(rows, "record int, place int, id string, title string, queries array<string>")
    index = linkage.cached_index(records, ["record", "place"])
    assert sorted((r["query"], r["id"], r["title"]) for r in index.collect()) == [("p", "a", "first"), ("q", "a", "first"), ("q", "b", "other"), ("r", "a", "second")]
    queries = spark.createDataFrame([("x", 0, "q"), ("x", 1, "r"), ("x", 2, "gone")], "album_id string, place int, query string")
    found = {r["id"]: r["queries"] for r in linkage.retrieve(queries, index, 1).collect()}
    assert found == {"a": ["q", "r"]}
    assert {r["id"]: r["title"] for r in linkage.kept_details(records, ["record", "place"], "title").collect()} == {"a": "first", "b": "other", "c": None}


def _trained(asked, index, truth, weights, iterations, calls, limit=5):
    """One round after the other, one call after the other."""
    weights, stats, used, uncovered = dict(weights), {}, 0, sorted(truth)
    for _ in range(iterations):
        each = (calls - used) // len(uncovered) if uncovered else 0
        if each < 1:
            break
        covered = set()
        for album in uncovered:
            for template, query in asked(album, each, weights):
                a, h = stats.get(template, (0, 0))
                hit = truth[album] in index.get(query, [])[:limit]
                stats[template] = (a + 1, h + hit)
                used += 1
                if hit:
                    covered.add(album)
                    break
        for template, (a, h) in stats.items():
            weights[template] = weights.get(template, 0.5) * (0.5 + h / a)
        uncovered = [u for u in uncovered if u not in covered]
    return len(truth) - len(uncovered), used, weights, stats


def test_training_keeps_to_its_budget(spark):
    """Over the benchmark: calls, coverage and weights are those of a loop that asks one query after the other."""
    asked, index, truth = file_plans._training(spark, SF)
    entries = {}
    for r in index.orderBy("pos").collect():
        entries.setdefault(r["query"], []).append(r["id"])
    wanted = {r["album_id"]: r["truth_id"] for r in truth.collect()}
    for calls in (25, 60):
        found = file_plans.trained_coverage(spark, SF, calls=calls, iterations=3).collect()

        def selected(album, each, weights):
            rows = linkage.select_queries(asked.where(asked["album_id"] == album), each, weights).orderBy("place").collect()
            return [(r["template"], r["query"]) for r in rows]

        covered, used, weights, stats = _trained(selected, entries, wanted, lexicon.TEMPLATE_WEIGHTS, 3, calls)
        assert {(r["covered"], r["total"], r["calls"]) for r in found} == {(covered, len(wanted), used)} and used <= calls
        assert {r["template"]: round(r["weight"], 9) for r in found} == {t: round(w, 9) for t, w in weights.items()}
        assert {r["template"]: (r["attempts"], r["hits"]) for r in found if r["attempts"]} == stats


def test_tickers_of_lines(spark):
    lines = spark.createDataFrame([(k, re.sub(r"\{[nw]\}", "9", x)) for k, x in enumerate(file_plans.TICKERS)], "line_no long, line string")
    assert sorted((r["line_no"], r["ticker"]) for r in readers.tickers(lines).collect()) == [(0, "AB9"), (3, "X9"), (7, "T9")]


def test_asked_grams_by_look_up_and_by_join(spark):
    """However many n-grams are asked for: none, some, or more than a task may hold; null and short texts hold none."""
    docs = spark.createDataFrame([(1, ["a", "b", "c", "d", "a", "b", "c"]), (2, ["b", "c"]), (3, None), (4, []), (1, ["x", "b", "c"])], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([("a b c",), ("b c d",), ("a b c",), ("z z z",), ("x b c",)], "query string")
    expected = [(1, "a b c"), (1, "b c d"), (1, "x b c")]
    for most in (100, 3):
        assert sorted(tuple(r) for r in linkage.held_grams(docs, asked, 3, most).collect()) == expected
    assert linkage.held_grams(docs, asked.limit(0), 3).count() == 0


def test_asked_grams_of_several_sizes_in_one_pass(spark):
    """Grams of one to four words at once, against a plain loop; words that no gram has, slices, and grams whose size is not asked for."""
    rng = random.Random(3)
    docs = [(k, None if k % 19 == 5 else [rng.choice("abcdexyz") for _ in range(rng.randint(0, 30))]) for k in range(300)]
    grams = {" ".join(rng.choice("abcde") for _ in range(n)) for n in (1, 2, 3, 4, 5) for _ in range(40)}
    asked = spark.createDataFrame([(g,) for g in sorted(grams)], "query string")
    frame = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(3)
    for sizes in ((1, 2, 4), (3,)):
        expected = sorted({(k, g) for k, words in docs for n in sizes for j in range(len(words or []) - n + 1) if (g := " ".join(words[j : j + n])) in grams})
        for most in (1000, 10):
            assert sorted(tuple(r) for r in linkage.held_grams(frame, asked, sizes, most).collect()) == expected


def test_long_texts_are_normalised_as_others_are(spark):
    from lintel.functions import text

    odd = ["", None, "  ", "Ünïcode—Straße ﬁne №5 ½ x²", "a’b ‘c’ “D” ÆØ", "x\u0000y\x7fz\t\n_", "𝐀𝐛 Ⅷ ㎏ ｆｕｌｌ", "é ẛ̣", "日本 ǅ ŉ …", "\U000e0001 ﷺ tail", "Ā" * 50 + "9"]
    every = [chr(c) + "q" for c in range(0x20, 0x3400) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xF900, 0x10000)] + [chr(c) for c in range(0x1D400, 0x1D800)] + [chr(c) for c in range(0x1F100, 0x1F200)]
    rows = spark.createDataFrame([(v,) for v in [*odd, " ".join(every), "|".join(every)]], "v string")
    told = rows.select("v", text.normalize(F.col("v")).alias("a"), text.normalize_long(F.col("v")).alias("b")).collect()
    assert [r["b"] for r in told] == [r["a"] for r in told]


def test_documents_are_looked_through_once(spark, monkeypatch):
    """Queries, starts, ends and all 4-grams of the benchmark are looked up in one pass over the documents."""
    from lintel.plans import linkage_plans

    passes, look_up = [], linkage.held_grams

    def counted(docs, *rest):
        passes.append(rest)
        return look_up(docs, *rest)

    monkeypatch.setattr(linkage, "held_grams", counted)
    for name in ("eval_recall", "eval_metrics"):
        passes.clear()
        assert linkage_plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 1
        assert len(passes) == 1
