"""Queries over documents, catalogue resources and progress streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.functions import text
from lintel.operators import documents, selection
from lintel.operators.runs import descendants, with_batches
from lintel.plans.tables import copies, copies_sql, forms, forms_sql, table, values_sql
from lintel.streaming import progress

#: Page specifications and page counts; what they give: single pages, a page from which all to the last are meant, or a problem.
SPECS = [
    ("1,3,5-10", "{n}"), ("5-N", "{n}"), ("1-3,N", "{n}"), ("", "{n}"), ("0", "5"), ("4-2", "{n}"), ("1,,{n}", "{n}"), ("2-", "{n}"), ("1-2-3", "{n}"), ("N-1", "{n}"), ("1{n}", "{n}"), ("a", "3"), ("2", "0"),
    ("N", "{n}"), ("2,90-N", "{n}"), ("{n}-N", "{n}"),
]
LISTED = [
    ("1,3,5,6,7,8,9,10", None, None), ("", 5, None), ("1,2,3,{n}", None, None), (None, None, "empty item"), (None, None, "pages start at 1"), (None, None, "end before start"), (None, None, "empty item"),
    (None, None, "malformed range"), (None, None, "malformed range"), (None, None, "end before start"), (None, None, "outside the document"), (None, None, "not a page number"), (None, None, "no pages"),
    ("{n}", None, None), ("2,", 90, None), ("{n}", None, None),
]
MARKDOWN = """intro

## First **A{n}** ![x](u)
[Review](http://m/review/first-disc)
Anna Prohaska sop; BBC SO (Harmonia Mundi) {w}
text {w}

* * *
## Second
[Go](http://m/Review/two)
Plain Player
Label: Big Label
see https://music.example/album/7

* * *
## No review
line
* * *
## Third
[Go](http://m/review/three)
""".split("\n")
REVIEWS = """intro

## First **A{n}** ![x](u)
**Anna Prohaska** sop; BBC SO (Harmonia Mundi)
[Review](http://m/review/first-disc)
late text
* * *
## [Second Work{n}](http://m/Review/two)
Label: Big Label
Plain Player
see text
* * *
## No review
line
* * *
## ![](picture)
## Third Work
[Go](http://m/review/three)
after the link
* * *
## First A{n}
Anna Prohaska sop; BBC SO (Harmonia Mundi)
[Again](http://m/review/again)
* * *
## 1999
Someone (Label)
[Year](http://m/review/year)
* * *
## Related Reviews
* * *
## Fifth Work
Player (Label)
[Late](http://m/review/late)
""".split("\n")
LINES = [("m", i + 1, s) for i, s in enumerate(MARKDOWN)]
LINE_COLUMNS = "file string, line_no int, line string"
UPDATES = [("m", 5, "[Listen](http://l/1{n})"), ("m", 6, "[Listen](http://l/2)"), ("m", 10, "[Listen](http://l/3)"), ("m", 19, "[Listen](http://l/4)")]
FENCED = "pre {w}\n## A{n}\n```\n## not\n~~~\n````\n## B ##\n~~~~\n## no\n~~~\n## no\n~~~~ \n## A\nend\n### deep".split("\n")
FILES = [("b1", "back_cover.jpg"), ("b1", "Cover.JPG"), ("b1", "front.png"), ("b2", "z{n}.png"), ("b2", "my{w}folder.jpeg"), ("b3", "{w}.jpg"), ("b3", "Ma{n}.png"), ("b3", ".cover.jpg"), ("b4", "x.txt")]
RESOURCE = (
    '{"data":{"id":"9","relationships":{"albums":{"data":[{"id":"2","type":"albums"},{"id":"1","type":"albums"},{"id":"7","type":"albums"}]}}},'
    '"included":[{"id":"1","type":"albums","attributes":{"title":"One {w}"}},{"id":"2","type":"albums","attributes":{"title":"Two {n}"}},{"id":"7","type":"artists","attributes":{"title":"No"}}]}'
)
TABLE_PAGES = [(1, "<table><tr><th>A</th><th> b </th></tr><tr><td>1<b>x{n}</b></td><td>2</td></tr></table><table><tr><td>{w}"), (2, "no table")]
LOG = [
    "INFO: Stage A{n} started", "INFO: Stage A started (two: {w})", "INFO: Stage: B:  45.2%, elapsed 01:23, ETA 01:42", "INFO: C: elapsed 01:23",
    "INFO: D finished in 02:15", "INFO: D finished in 02:15 (ok {n})", "INFO: free text: {w}", "ERROR: no", "  INFO: E: 100%", "INFO: F: processed 01:00, elapsed 02:00",
]
FAILED = [
    ("r1", "bash: line 1: uv: command not found"), ("r1", "OPENAI_API_KEY is not set"), ("r2", "x"), ("r2", "Error: OpenAI API request failed (HTTP 429)"), ("r2", "API error (quota {n}): no"),
    ("r3", "binary not found or not executable: /opt/bin/whisper-cli"), ("r4", "Missing required Python package: No module named 'mlx_audio'"), ("r5", "just {n}"), ("r5", "text"),
    ("r6", "Whisper model not found: /m/x{n}.bin"), ("r7", "zsh: command not found: ffmpeg"), ("r8", "is intended for Apple Silicon Macs"),
]
FAILED_ROWS = [(r, i, s) for i, (r, s) in enumerate(FAILED)]
SETTINGS = [(1, "A=1\nB={n}=y\nA=2{n}\nBASH_FUNC_f=()\n=z\nnone"), (2, ""), (3, "HOME=/{w}\nEMPTY=\nHOME=/tmp")]
CHUNKS = [("a", 1, "68C3"), ("a", 2, "A96C0D0A"), ("a", 3, "776F"), ("b", 1, "0A0A78"), ("c", 1, "")]
EDGES = [(1, 2), (1, 3), (3, 4), (4, 5), (9, 8), (5, 6), (6, 4)]

#: What is read from the texts above.
BLOCKS = [("m", 3, "First A{n}", "Anna Prohaska sop; BBC SO", "Harmonia Mundi"), ("m", 8, "[Second Work{n}](http://m/Review/two)", "Plain Player", "Big Label")]
PLACED = [("m", 5, 6, "[Listen](http://l/1{n})", False), ("m", 10, 13, "[Listen](http://l/3)", True), ("m", 19, 20, "[Listen](http://l/4)", False)]
CELLS = [("p", 0, 0, 0, "A"), ("p", 0, 0, 1, "b"), ("p", 0, 1, 0, "1 x{n}"), ("p", 0, 1, 1, "2"), ("p", 1, 0, 0, "{w}")]
PARSED = [
    ("Stage A{n}", None, True, False, None), ("Stage A", None, True, False, "two: {w}"), ("Stage: B", 45.2, False, False, "elapsed 01:23, ETA 01:42"), ("C", None, False, False, "elapsed 01:23"),
    ("D", None, False, True, None), ("D", None, False, True, "ok {n}"), ("free text: {w}", None, False, False, None), (None, None, None, None, None), ("E", 100.0, False, False, None),
    ("F", None, False, False, "processed 01:00, elapsed 02:00"),
]
CLASSIFIED = [
    ("r1", "missing_api_key", "OPENAI_API_KEY"), ("r2", "api_error", "OpenAI API request failed (HTTP 429) API error (quota {n}): no"), ("r3", "missing_dependency", "whisper-cpp"), ("r4", "missing_dependency", "mlx-audio"),
    ("r5", "unknown", "just {n}\ntext"), ("r6", "missing_model", "/m/x{n}.bin"), ("r7", "missing_dependency", "ffmpeg"), ("r8", "unsupported_hardware", "VibeVoice requires Apple Silicon"),
]


def page_ranges(spark, sf_dir):
    out = documents.page_lists(forms(spark, sf_dir, "spec string, page_count string", SPECS).withColumn("page_count", F.col("page_count").cast("int")))
    return out.select("pos", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "problem")


def page_islands(spark, sf_dir):
    return documents.range_texts(table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 50).alias("page")), ["l_suppkey"], "page")


def batch_ids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return with_batches(orders, ["o_custkey"], 4, "o_orderkey")


def missing_chunks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    done = with_batches(orders.where("o_orderkey % 3 <> 0"), ["o_custkey"], 4, "o_orderkey").groupBy("o_custkey", "batch").agg(F.sum(F.col("o_orderkey") % 2).alias("length"))
    return documents.missing_chunks(orders, ["o_custkey"], "o_orderkey", 4, done)


def chapter_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") * 0.0625).alias("seconds"))
    return documents.chapter_marks(rows, ["conv_id"], "turn", "seconds").select("conv_id", "turn", "start_ms", "end_ms")


def cover_pick(spark, sf_dir):
    return documents.cover_of_each(copies(spark, sf_dir, "book string, name string", FILES), ["book"], "name")


def markdown_sections(spark, sf_dir):
    lines = copies(spark, sf_dir, LINE_COLUMNS, [("f", i + 1, s) for i, s in enumerate(FENCED)])
    return documents.section_files(documents.fenced_sections(lines, "file"), "file")


def markdown_blocks(spark, sf_dir):
    reviews = copies(spark, sf_dir, LINE_COLUMNS, [("m", i + 1, s) for i, s in enumerate(REVIEWS)])
    return documents.review_blocks(reviews, "file").select("file", "line_no", "title", "performer", "label")


def link_apply(spark, sf_dir):
    updates = copies(spark, sf_dir, "file string, source_line int, link string", UPDATES)
    return documents.with_links(copies(spark, sf_dir, LINE_COLUMNS, LINES), updates, "file", ["music.example/album/", "Listen on"])


def html_headings(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit(r"<h1>([^<]*)</h1>"), 1)
    return pages.select("page_id", F.explode(found).alias("heading")).select("page_id", text.squeeze(F.col("heading")).alias("heading"))


def html_cells(spark, sf_dir):
    return documents.html_tables(forms(spark, sf_dir, "html string", [(h,) for _, h in TABLE_PAGES], "page"), "page", "html")


def resource_lookup(spark, sf_dir):
    found = documents.included_lookup(forms(spark, sf_dir, "raw string", [(RESOURCE,)], "doc"), "doc", "raw", "albums", "albums")
    return found.select("doc", "pos", "id", F.try_variant_get("attributes", "$.title", "string").alias("title"))


def settings(spark, sf_dir):
    rows = forms(spark, sf_dir, "raw string", [(s,) for _, s in SETTINGS])
    return rows.select("pos", F.explode(documents.settings_map(F.col("raw"))).alias("name", "value"))


def progress_parse(spark, sf_dir):
    return forms(spark, sf_dir, "line string", [(x,) for x in LOG]).select("pos", progress.parsed_progress(F.col("line")).alias("e")).where("e IS NOT NULL").select("pos", "e.*")


def error_classify(spark, sf_dir):
    return progress.classified_failures(copies(spark, sf_dir, "run string, line_no int, line string", FAILED_ROWS), ["run"])


def line_reassembly(spark, sf_dir):
    rows = copies(spark, sf_dir, "run string, seq int, h string", CHUNKS).withColumn("chunk", F.unhex("h"))
    return progress.reassembled_lines(rows, ["run"])


def _updates(events):
    return events.select(
        F.col("event_type").alias("stage"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") * 60.0).alias("now"),
        (F.col("event_id") % 101).cast("double").alias("completed"),
        F.lit(100.0).alias("total"),
        (F.col("event_id") % 97 == 0).alias("force"),
    )


def progress_throttle(spark, sf_dir):
    return progress.throttled(_updates(table(spark, sf_dir, "events")), 3600.0).select("stage", "seq", F.round("percent", 9).alias("percent"))


def latest_progress(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return progress.latest(events, ["user_id"], "event_id")


def process_closure(spark, sf_dir):
    """All descendants of the first process of each document's process table, which has a cycle."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") * 100).alias("first"))
    edges = docs.select("first", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")) for p, c in EDGES])).alias("e"))
    edges = edges.select((F.col("first") + F.col("e.p")).alias("parent"), (F.col("first") + F.col("e.c")).alias("child"))
    return descendants(edges, "parent", "child", docs.select((F.col("first") + 1).alias("child")))


def joined_chunks(spark, sf_dir):
    """The lines of each conversation in one text, chunks apart by a blank line."""
    return selection.joined_texts(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


QUERIES = {
    f.__name__: f
    for f in (
        page_ranges, page_islands, batch_ids, missing_chunks, chapter_offsets, cover_pick, markdown_sections, markdown_blocks, link_apply, html_headings,
        html_cells, resource_lookup, settings, progress_parse, error_classify, line_reassembly, progress_throttle, latest_progress, process_closure, joined_chunks,
    )
}

_BLOCKS = f"""l AS (SELECT *, regexp_matches(trim(line), '^\\*\\s+\\*\\s+\\*$') AS sep, sum(CAST(regexp_matches(trim(line), '^\\*\\s+\\*\\s+\\*$') AS INT)) OVER (PARTITION BY file ORDER BY line_no) AS block FROM {copies_sql(LINE_COLUMNS, LINES)})"""
ORACLES = {
    "page_islands": """WITH p AS (SELECT DISTINCT l_suppkey, l_orderkey % 50 AS page FROM lineitem), i AS (SELECT *, page - row_number() OVER (PARTITION BY l_suppkey ORDER BY page) AS g FROM p),
        r AS (SELECT l_suppkey, min(page) AS lo, max(page) AS hi FROM i GROUP BY l_suppkey, g) SELECT l_suppkey, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ',' ORDER BY lo) AS ranges FROM r GROUP BY 1""",
    "page_ranges": f"""SELECT pos, CASE WHEN lo IS NULL THEN pages ELSE pages || array_to_string(range(lo, pos % 900 + 101), ',') END AS pages, problem FROM {forms_sql('pages string, lo int, problem string', LISTED)}""",
    "batch_ids": "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS batch FROM orders",
    "missing_chunks": """WITH w AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS batch FROM orders),
        d AS (SELECT o_custkey, batch FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS batch FROM orders WHERE o_orderkey % 3 <> 0) GROUP BY 1, 2 HAVING sum(o_orderkey % 2) > 0)
        SELECT o_custkey, batch, count(*) AS items FROM w ANTI JOIN d USING (o_custkey, batch) GROUP BY 1, 2""",
    "chapter_offsets": """WITH e AS (SELECT conv_id, turn, CAST(round_even(sum(CAST(length(text) AS DOUBLE) * 62.5) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS BIGINT) AS end_ms FROM conversations)
        SELECT conv_id, turn, coalesce(lag(end_ms) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS start_ms, end_ms FROM e""",
    "cover_pick": f"""WITH p AS (SELECT book, name, lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem FROM {copies_sql('book string, name string', FILES)} WHERE regexp_matches(lower(name), '\\.(jpg|jpeg|png)$') AND NOT starts_with(name, '.')),
        r AS (SELECT book, name, CASE stem WHEN 'cover' THEN 0 WHEN 'front' THEN 1 WHEN 'folder' THEN 2 ELSE CASE WHEN contains(stem, 'cover') THEN 3 WHEN contains(stem, 'front') THEN 4 WHEN contains(stem, 'folder') THEN 5 ELSE 6 END END AS rank FROM p)
        SELECT book, name FROM r QUALIFY row_number() OVER (PARTITION BY book ORDER BY rank, CASE WHEN rank = 6 THEN lower(name) ELSE '' END, name) = 1""",
    "markdown_blocks": f"SELECT * FROM {copies_sql('file string, line_no int, title string, performer string, label string', BLOCKS)}",
    "link_apply": f"""WITH {_BLOCKS}, u AS (SELECT * FROM {copies_sql('file string, src int, place int, link string, old boolean', PLACED)}),
        x AS (SELECT l.file, line_no, 0 AS k, CASE WHEN old THEN link ELSE line END AS line FROM l LEFT JOIN u ON l.file = u.file AND l.line_no = u.place
              UNION ALL SELECT file, place, k, CASE k WHEN 2 THEN link ELSE '' END FROM u, range(1, 4) AS r(k) WHERE NOT old)
        SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no, k) AS line_no, line FROM x""",
    "html_headings": r"SELECT page_id, trim(regexp_replace(h, '\s+', ' ', 'g')) AS heading FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS h FROM pages)",
    "html_cells": f"SELECT doc_id AS page, table_no, row_no, col_no, text FROM (SELECT *, split_part(page, '-', 2)::BIGINT AS doc_id FROM {copies_sql('page string, table_no int, row_no int, col_no int, text string', CELLS)}) WHERE doc_id % {len(TABLE_PAGES)} = 0",
    "resource_lookup": f"""WITH d AS (SELECT doc, CAST(raw AS JSON) AS j FROM {forms_sql('raw string', [(RESOURCE,)], 'doc')}),
        r AS (SELECT doc, unnest(CAST(j->'$.data.relationships.albums.data' AS JSON[])) AS r, generate_subscripts(CAST(j->'$.data.relationships.albums.data' AS JSON[]), 1) - 1 AS pos FROM d),
        i AS (SELECT doc, unnest(CAST(j->'$.included' AS JSON[])) AS i FROM d) SELECT r.doc, pos, r->>'id' AS id, i->>'$.attributes.title' AS title FROM r JOIN i ON r.doc = i.doc AND r->>'id' = i->>'id' AND r->>'type' = i->>'type'""",
    "settings": f"""WITH e AS (SELECT pos, unnest(string_split(raw, chr(10))) AS e, generate_subscripts(string_split(raw, chr(10)), 1) AS k FROM {forms_sql('raw string', [(s,) for _, s in SETTINGS])})
        SELECT pos, split_part(e, '=', 1) AS name, substr(e, strpos(e, '=') + 1) AS value FROM e WHERE strpos(e, '=') > 1 AND NOT starts_with(e, 'BASH_FUNC_') QUALIFY row_number() OVER (PARTITION BY pos, split_part(e, '=', 1) ORDER BY k DESC) = 1""",
    "progress_parse": f"SELECT * FROM {forms_sql('stage string, percent double, is_start boolean, is_finished boolean, detail string', PARSED)} WHERE stage IS NOT NULL",
    "error_classify": f"SELECT * FROM {copies_sql('run string, kind string, payload string', CLASSIFIED)}",
    "line_reassembly": f"""WITH w AS (SELECT run, decode(from_hex(string_agg(h, '' ORDER BY seq))) AS t FROM {copies_sql('run string, seq int, h string', CHUNKS)} GROUP BY run),
        l AS (SELECT run, string_split(regexp_replace(t, chr(10) || '$', ''), chr(10)) AS l FROM w WHERE t <> '')
        SELECT run, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no, rtrim(unnest(l), chr(13)) AS line FROM l""",
    "progress_throttle": """WITH RECURSIVE e AS (SELECT event_type AS stage, event_id AS seq, event_id * 60.0 AS now, event_id % 97 = 0 AS force, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
        f AS (SELECT stage, seq, n, force OR now >= 3600 AS shown, CASE WHEN force OR now >= 3600 THEN now ELSE 0.0 END AS last FROM e WHERE n = 1
              UNION ALL SELECT e.stage, e.seq, e.n, e.force OR e.now - f.last >= 3600, CASE WHEN e.force OR e.now - f.last >= 3600 THEN e.now ELSE f.last END FROM f JOIN e ON e.stage = f.stage AND e.n = f.n + 1)
        SELECT stage, seq, CAST(seq % 101 AS DOUBLE) AS percent FROM f WHERE shown""",
    "latest_progress": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1",
    "process_closure": f"WITH RECURSIVE e AS (SELECT doc_id * 100 + parent AS parent, doc_id * 100 + child AS child FROM documents, {values_sql('parent long, child long', EDGES)}), d AS (SELECT child FROM e WHERE parent % 100 = 1 UNION SELECT e.child FROM d JOIN e ON e.parent = d.child) SELECT child FROM d",
    "joined_chunks": "SELECT conv_id, string_agg(rtrim(text), chr(10) || chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY 1",
}
