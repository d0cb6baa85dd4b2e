"""Queries over records, JSON values, candidates and pages of resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.functions import json_values, lexicon, text, values
from lintel.operators import candidates, documents, people, records
from lintel.plans.document_plans import LINE_COLUMNS, REVIEWS
from lintel.plans.tables import copies, fixture, forms, forms_sql, literal, table, values_sql
from lintel.sources import readers
from lintel.streaming import progress

JSON_LISTS = ['["a{n}", " b {w}", "", null, {n}, true]', '"one {w}"', '" "', "null", "0", "7", "[]", '{"a": 1}', "false", "[null]"]
FLOAT_MAPS = ['{"a": {n}, "b": "2.{n}", "c": true}', "[1]", "{}", '{"x{w}": -0.{n}}', "null", '{"y": " 7 "}']
PATHS = ["/v1/pages/album?albumId={n}&x=2&x=3{w}", "https://api.example/v2/a/b?cursor=%2Fq%3D&e=", "pages/home", "items?a={w}{n}", "/plain", "https://h.example/p#top"]
PAGES = [
    (1, '{"items": [{"item": {"id": {n}, "type": "track"}}, {"id": "{w}"}, {"type": "video", "id": 7}, {"id": 5}, 3]}'),
    (2, '{"rows": [{"modules": [{"type": "ALBUM_ITEMS", "pagedList": {"dataApiPath": "next/{n}", "items": [{"item": {"id": 9}, "type": "track"}]}, "items": [{"id": 10}]}, {"type": "OTHER", "items": [{"id": 11}]}]}], "modules": [{"type": "ALBUM_ITEMS", "items": [{"item": {"id": 8, "type": "track"}}]}]}'),
    (3, "not json"),
    (4, '{"items": 5, "modules": [{"type": "ALBUM_ITEMS", "pagedList": {"dataApiPath": "p4"}}]}'),
]
PLAIN_LINES = [
    ("p", i + 1, line)
    for i, line in enumerate(
        """# Page

**BACH Goldberg Variations**
---
**Glenn Gould** pf
**Vienna Philharmonic / Carlos Kleiber** (Sony Classical)

**Short heading line**
text (with parentheses)
**MAHLER Symphony No 2**
=====
**Anna Prohaska** sop
Label: Big Label
**20th year**
**Nothing follows here**
---
text only
**BACH Goldberg Variations**
---
Glenn Gould
**Vienna Philharmonic / Carlos Kleiber** (Sony Classical)""".split("\n")
    )
]
HINTS = ["Martha Argerich pf Berlin Philharmonic / Claudio Abbado", "Anna Prohaska; Julius Drake, LSO, Chorus", "Smith vn Jones va", "", None, "LPO / BBC Symphony Orchestra", "with; One, Two"]
PEOPLE = ["**Anna Prohaska** _sop_ **Julius Drake** _pf_ (Alpha)", "LSO / Simon Rattle", "**Berlin Philharmonic / Herbert von Karajan**; Gould (DG)", ""]
SECONDS_LINES = ["out_time=00:01:02.500000", "out_time_us=15{n}00", "progress=end", "out_time_ms=2000000", "x"]
NOTES = ["progress = {n}%", "whisper_print_progress_callback: progress =  5%", "none", "100 %"]


def percent_shown(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", records.percent_text(F.col("p_retailprice") / 100000 - F.lit(0.01)).alias("shown"))


def feature_text(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    named = F.create_map(F.lit("title"), F.col("p_size") / F.lit(50.0), F.lit("label"), F.when(F.col("p_size") % 3 == 0, F.lit(0.125)).otherwise(F.lit(0.0)))
    return records.feature_text(parts.select("p_partkey", named.alias("f")), "p_partkey", "f")


def record_ids(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    file, line = F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size"))
    return part.select("p_partkey", records.record_id(file, line, F.col("p_name")).alias("record_id"))


def _results(spark, sf_dir):
    """Customers as albums, their orders as ranked candidates, dear ones chosen."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("album_id"), F.col("c_mktsegment").alias("file"), F.col("c_nationkey").cast("int").alias("line"), F.col("c_name").alias("raw"), F.lit("").alias("subsection"),
        F.create_map(F.lit("k"), F.col("c_name")).alias("context"), F.col("c_name").alias("title"),
    )
    orders = table(spark, sf_dir, "orders").withColumn("rank", F.expr("CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT)"))
    ranked = orders.select(F.col("o_custkey").alias("album_id"), F.col("o_orderkey").cast("string").alias("id"), "rank", (F.col("o_totalprice") / 1e6).alias("score"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"))
    choices = ranked.where("rank = 1").select("album_id", F.when(F.col("score") >= 0.2, F.col("id")).alias("id"), F.when(F.col("score") >= 0.2, "dear").otherwise("").alias("reason"))
    return customers, ranked, choices


def match_records(spark, sf_dir):
    out = records.records(*_results(spark, sf_dir), mode="auto", top=2)
    ids = F.array_join(F.transform("top_candidates", lambda c: c["id"]), ",")
    return out.select("record_id", "source.raw", F.coalesce(ids, F.lit("")).alias("top"), "chosen_id", "status", "review.top_score", "review.top_release_year", "review.candidate_count", "review.auto_reason")


def link_updates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "selected").when(F.col("o_orderstatus") == "O", "auto_selected").otherwise("none")
    rows = orders.select(
        F.col("o_custkey").alias("file"), (F.col("o_orderkey") - 3).alias("source_line"), status.alias("status"),
        F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))).otherwise("  ").alias("id"), F.lit(" t ").alias("title"),
    )
    return records.link_updates(rows).select("file", "pos", "source_line", "id", "title")


def _kept(spark, sf_dir):
    """Users with kept query candidates, kept queries, or queries of candidates, by turns."""
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    kinds = F.transform("e", lambda x: x["event_type"])
    pairs = F.transform("e", lambda x: F.struct(F.lit("t").alias("template"), x["event_type"].alias("query")))
    none = F.array().cast("array<struct<template:string,query:string>>")
    return events.select("user_id", F.when(F.col("user_id") % 3 == 0, pairs).otherwise(none).alias("query_candidates"), F.when(F.col("user_id") % 3 == 1, kinds).alias("queries"), F.transform("e", lambda x: F.array(x["event_type"], F.lit(""))).alias("candidate_queries"))


def cached_queries(spark, sf_dir):
    return records.cached_queries(_kept(spark, sf_dir), "user_id")


def json_lists(spark, sf_dir):
    rows = forms(spark, sf_dir, "raw string", [(x,) for x in JSON_LISTS])
    return records.read_lists(rows, "raw").select("pos", F.array_join("strings", "|").alias("strings"), F.array_join("texts", "|").alias("texts"))


def float_maps(spark, sf_dir):
    rows = forms(spark, sf_dir, "raw string", [(x,) for x in FLOAT_MAPS]).select("pos", json_values.float_map(F.try_parse_json("raw")).alias("m"))
    return rows.select("pos", F.explode("m").alias("key", "value"))


def page_paths(spark, sf_dir):
    path, query = json_values.path_and_query(F.col("raw"))
    rows = forms(spark, sf_dir, "raw string", [(x,) for x in PATHS])
    shown = F.transform(F.array_sort(F.map_entries(query)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("pos", path.alias("path"), F.array_join(shown, "&").alias("query"))


def page_tracks(spark, sf_dir):
    ids, paths = records.page_tracks(forms(spark, sf_dir, "doc string", [(d,) for _, d in PAGES], "page"), "page", "doc")
    rank = F.expr("CAST(row_number() OVER (PARTITION BY page ORDER BY pos) AS INT)")
    return ids.select("page", F.lit("track").alias("kind"), rank.alias("nth"), F.col("id").alias("value")).unionAll(paths.select("page", F.lit("path"), rank, "path"))


def longest_listings(spark, sf_dir):
    """A customer's orders by status as three sources; six are expected."""
    orders = table(spark, sf_dir, "orders").withColumn("source", F.expr("CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS INT)"))
    lists = orders.groupBy("o_custkey", "source").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids")).withColumn("expected", F.when(F.col("o_custkey") % 2 == 0, F.lit(6)))
    return records.longest_listing(lists, "o_custkey").select("o_custkey", "source", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def named_lists(spark, sf_dir):
    asked = fixture(spark, "name string", [("EUROPE",), ("asia",), ("EUROPE",)])
    return records.with_name(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name")), asked)


def first_values(spark, sf_dir):
    shown = F.when(F.col("event_id") % 4 == 0, F.lit(" ")).when(F.col("event_id") % 4 == 1, F.lit("VALUE")).otherwise(F.concat(F.lit(" "), "event_type"))
    cells = table(spark, sf_dir, "events").select("user_id", "event_id", shown.alias("cell"))
    return records.first_value(cells, ["user_id"], "event_id", "cell", "value")


def head_rows(spark, sf_dir):
    return records.head_rows(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


def listed_words(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.concat("p_name", F.lit(", ,"), "p_brand"), F.lit(" ")).alias("v"))
    return rows.select("p_partkey", F.array_join(records.listed_words(F.col("v")), "|").alias("words"))


def book_folders(spark, sf_dir):
    names = F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit("."), F.when(F.col("p_size") % 2 == 0, F.lit("M4A")).otherwise(F.lit("txt")))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("/a/"), F.col("p_brand")).alias("folder"), names.alias("name"))
    return records.books(files, readers.AUDIO, "/a/Brand#11", "brand#")


def listening_minutes(spark, sf_dir):
    return records.whole_minutes(table(spark, sf_dir, "events").where("value IS NOT NULL"), ["user_id"], "value")


def plain_candidates(spark, sf_dir):
    return candidates.plain_candidates(copies(spark, sf_dir, LINE_COLUMNS, PLAIN_LINES))


def file_candidates(spark, sf_dir):
    """Blocks where a file has them, plain titles where it has none."""
    reviews = copies(spark, sf_dir, LINE_COLUMNS, [("m", i + 1, s) for i, s in enumerate(REVIEWS)])
    blocks = documents.review_blocks(reviews, "file")
    lines = reviews.unionAll(copies(spark, sf_dir, LINE_COLUMNS, PLAIN_LINES))
    out = candidates.markdown_candidates(blocks, lines)
    return out.where(candidates.file_kind(F.concat("file", F.lit(".md"))) == "markdown")


def plain_performers(spark, sf_dir):
    said = forms(spark, sf_dir, "hint string", [(x,) for x in HINTS]).select("pos", candidates.plain_performers(F.col("hint")).alias("p")).select("pos", "p.*")
    return said.select("pos", *[F.array_join(c, "|").alias(c) for c in ("performers", "ensembles", "instruments")], "conductor")


def marked_performers(spark, sf_dir):
    lines = forms(spark, sf_dir, "performer_line string", [(x,) for x in PEOPLE]).withColumn("label_line", F.lit(""))
    return people.performer_parts(lines, "pos").select("pos", *[F.array_join(c, "|").alias(c) for c in ("performers", "ensembles", "instruments")], "conductor", "label")


def album_entries(spark, sf_dir):
    found = candidates.plain_candidates(copies(spark, sf_dir, LINE_COLUMNS, PLAIN_LINES)).withColumn("candidate", F.concat_ws(":", "file", F.col("line_no").cast("string")))
    out = candidates.album_entries(found)
    lists = [F.array_join(f"album.{c}", "|").alias(c) for c in ("composers", "performers", "ensembles", "works", "instruments")]
    return out.select("candidate", "source.line", "album.title", *lists, "album.conductor", "album.label")


def shown_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.when(F.col("p_size") % 4 > 1, F.concat(F.lit(" "), "p_brand")).otherwise(" nan ")).alias("cell"))
    return rows.select("p_partkey", values.blank(F.col("cell")).alias("blank"))


def transfer_progress(spark, sf_dir):
    seconds = forms(spark, sf_dir, "line string", [(x,) for x in SECONDS_LINES]).select("pos", F.lit("time").alias("kind"), progress.transfer_seconds(F.col("line")).alias("value"))
    noted = forms(spark, sf_dir, "line string", [(x,) for x in NOTES]).select("pos", F.lit("percent").alias("kind"), progress.noted_percent(F.col("line")).cast("double").alias("value"))
    return seconds.unionAll(noted)


def model_weights(spark, sf_dir):
    """The weights of a training model that each part overlays: its size as the weight of one feature, known or not, and of one that is not."""
    names = [*lexicon.FEATURE_WEIGHTS, "unknown"]
    own = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    overlay = F.create_map(own, F.col("p_size") / 50.0, F.lit("another"), F.lit(9.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(readers.overlaid(lexicon.FEATURE_WEIGHTS, overlay)).alias("name", "weight"))


def heading_parts(spark, sf_dir):
    lines = forms(spark, sf_dir, "line string", [("## **BACH; Handel** Works {n}",), ("## J.S. BACH Mass in B minor {n}",), ("## Symphony {n}",), ("### **Mahler**",), ("",)])
    return lines.select("pos", F.array_join(text.heading_people(F.col("line")), "|").alias("people"), text.heading_title(F.col("line"), F.lit("Fallback")).alias("title"))


QUERIES = {
    f.__name__: f
    for f in (
        percent_shown, feature_text, record_ids, match_records, link_updates, cached_queries, json_lists, float_maps, page_paths, page_tracks,
        longest_listings, named_lists, first_values, head_rows, listed_words, book_folders, listening_minutes, plain_candidates, file_candidates,
        plain_performers, marked_performers, album_entries, shown_names, transfer_progress, heading_parts, model_weights,
    )
}

_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)"
_PARSED = f"p AS (SELECT page, try_cast(doc AS JSON) AS j FROM {forms_sql('doc string', [(d,) for _, d in PAGES], 'page')})"
ORACLES = {
    "percent_shown": "SELECT p_partkey, printf('%+.2f%%', (p_retailprice / 100000 - 0.01::DOUBLE) * 100) AS shown FROM part",
    "feature_text": """SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN 'label=' || printf('%.2f', 0.125::DOUBLE) ELSE '' END || ' ' || CASE WHEN p_size > 0 THEN 'title=' || printf('%.2f', p_size / 50.0::DOUBLE) ELSE '' END), ''), '(no signals)') AS features FROM part""",
    "record_ids": "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_brand ELSE '' END || '|' || CASE WHEN p_partkey % 3 > 0 THEN p_size ELSE 0 END || '|' || p_name AS record_id FROM part",
    "match_records": f"""WITH {_RANKED}, t AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 2) AS top, count(*) AS n, max(o_totalprice / 1e6) AS s, arg_max(strftime(o_orderdate, '%Y'), -rank) AS y,
                                arg_max(CAST(o_orderkey AS VARCHAR), -rank) AS id FROM r GROUP BY 1)
        SELECT c_mktsegment || '|' || c_nationkey || '|' || c_name AS record_id, c_name AS raw, coalesce(top, '') AS top, CASE WHEN s >= 0.2 THEN id END AS chosen_id, CASE WHEN s >= 0.2 THEN 'auto_selected' ELSE 'needs_review' END AS status,
               coalesce(round(s, 3), 0) AS top_score, coalesce(y, '') AS top_release_year, coalesce(n, 0) AS candidate_count, CASE WHEN s >= 0.2 THEN 'dear' ELSE '' END AS auto_reason FROM customer LEFT JOIN t ON c_custkey = o_custkey""",
    "link_updates": """SELECT o_custkey AS file, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INT) AS pos, o_orderkey - 3 AS source_line, CAST(o_orderkey AS VARCHAR) AS id, 't' AS title
        FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 7 > 0 AND o_orderkey > 3""",
    "cached_queries": """WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)
        SELECT user_id, CAST(pos AS INT) AS pos, CASE WHEN user_id % 3 = 0 THEN 't' ELSE 'cached' END AS template, event_type AS query FROM n WHERE user_id % 3 < 2
        UNION ALL SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT), 'cached', event_type FROM n WHERE user_id % 3 = 2 AND k = 1""",
    "json_lists": f"""WITH j AS (SELECT pos, CAST(raw AS JSON) AS j FROM {forms_sql('raw string', [(x,) for x in JSON_LISTS])}),
        k AS (SELECT pos, json_type(j) AS kind, j->>'$' AS one, CASE WHEN json_type(j) = 'ARRAY' THEN list_transform(CAST(j AS JSON[]), lambda x: CASE WHEN json_type(x) = 'NULL' THEN NULL ELSE trim(x->>'$') END) END AS items FROM j)
        SELECT pos, CASE WHEN kind = 'ARRAY' THEN array_to_string(list_filter(items, lambda x: x <> ''), '|') WHEN kind = 'NULL' OR one IN ('0', 'false') THEN '' ELSE trim(one) END AS strings,
               CASE WHEN kind = 'ARRAY' THEN array_to_string(list_filter(list_transform(items, lambda x: coalesce(x, 'None')), lambda x: x <> ''), '|') WHEN kind = 'VARCHAR' THEN trim(one) ELSE '' END AS texts FROM k""",
    "float_maps": f"""WITH j AS (SELECT pos, CAST(raw AS JSON) AS j FROM {forms_sql('raw string', [(x,) for x in FLOAT_MAPS])}), k AS (SELECT pos, j, unnest(json_keys(j)) AS key FROM j WHERE json_type(j) = 'OBJECT')
        SELECT pos, key, CASE j->>key WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 ELSE CAST(trim(j->>key) AS DOUBLE) END AS value FROM k""",
    "page_paths": f"""WITH r AS (SELECT pos, regexp_replace(regexp_replace(raw, '^https?://[^/?#]*', ''), '#.*$', '') AS b FROM {forms_sql('raw string', [(x,) for x in PATHS])}),
        q AS (SELECT pos, string_split(b, '?')[1] AS p, coalesce(list_filter(string_split(coalesce(string_split(b, '?')[2], ''), '&'), lambda x: regexp_matches(x, '^[^=]*=.')), []) AS l FROM r),
        d AS (SELECT pos, p, list_distinct(list_transform(l, lambda x: string_split(x, '=')[1])) AS names, l FROM q)
        SELECT pos, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS path,
               array_to_string(list_transform(list_sort(names), lambda n: n || '=' || url_decode(string_split(list_filter(l, lambda x: starts_with(x, n || '='))[-1], '=')[2])), '&') AS query FROM d""",
    "page_tracks": f"""WITH {_PARSED}, m AS (SELECT page, 1 AS o, i, m FROM (SELECT page, unnest(CAST(j->'$.modules' AS JSON[])) AS m, generate_subscripts(CAST(j->'$.modules' AS JSON[]), 1) AS i FROM p WHERE json_type(j->'$.modules') = 'ARRAY')
              UNION ALL SELECT page, 2, i, m FROM (SELECT page, unnest(CAST(j->'$.rows[0].modules' AS JSON[])) AS m, generate_subscripts(CAST(j->'$.rows[0].modules' AS JSON[]), 1) AS i FROM p WHERE json_type(j->'$.rows[0].modules') = 'ARRAY')),
        a AS (SELECT * FROM m WHERE m->>'$.type' = 'ALBUM_ITEMS'),
        e AS (SELECT page, 0 AS o, 0 AS i, 0 AS part, generate_subscripts(CAST(j->'$.items' AS JSON[]), 1) AS k, unnest(CAST(j->'$.items' AS JSON[])) AS e FROM p WHERE json_type(j->'$.items') = 'ARRAY'
              UNION ALL SELECT page, o, i, 1, generate_subscripts(CAST(m->'$.pagedList.items' AS JSON[]), 1), unnest(CAST(m->'$.pagedList.items' AS JSON[])) FROM a WHERE json_type(m->'$.pagedList.items') = 'ARRAY'
              UNION ALL SELECT page, o, i, 2, generate_subscripts(CAST(m->'$.items' AS JSON[]), 1), unnest(CAST(m->'$.items' AS JSON[])) FROM a WHERE json_type(m->'$.items') = 'ARRAY'),
        t AS (SELECT page, o, i, part, k, CASE WHEN json_type(e->'$.item') = 'OBJECT' THEN e->'$.item' ELSE e END AS item, e FROM e WHERE json_type(e) = 'OBJECT'),
        f AS (SELECT page, o, i, part, k, item->>'$.id' AS id FROM t WHERE coalesce(e->>'$.type', item->>'$.type', 'track') = 'track' QUALIFY row_number() OVER (PARTITION BY page, item->>'$.id' ORDER BY o, i, part, k) = 1)
        SELECT page, 'track' AS kind, CAST(row_number() OVER (PARTITION BY page ORDER BY o, i, part, k) AS INT) AS nth, id AS value FROM f
        UNION ALL SELECT page, 'path', CAST(row_number() OVER (PARTITION BY page ORDER BY o, i) AS INT), m->>'$.pagedList.dataApiPath' FROM a WHERE m->>'$.pagedList.dataApiPath' <> ''""",
    "longest_listings": """WITH l AS (SELECT o_custkey, CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS INT) AS source, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids, count(*) AS n FROM orders GROUP BY 1, 2),
        d AS (SELECT *, coalesce(max(CAST(o_custkey % 2 = 1 OR n >= 6 AS INT)) OVER (PARTITION BY o_custkey ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM l)
        SELECT o_custkey, source, ids FROM d WHERE done = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, source) = 1""",
    "named_lists": "SELECT r_regionkey, r_name AS name FROM region WHERE r_name IN ('EUROPE', 'asia')",
    "first_values": """SELECT user_id, coalesce(arg_min(event_type, event_id) FILTER (event_id % 4 > 1), '') AS first FROM events GROUP BY 1""",
    "head_rows": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3",
    "listed_words": "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(replace(p_name || ' ' || p_brand, ',', ' '), '\\s+'), lambda w: w <> ''), '|') AS words FROM part",
    "book_folders": """WITH b AS (SELECT DISTINCT p_brand FROM part WHERE p_size % 2 = 0 AND p_brand <> 'Brand#11')
        SELECT '/a/' || p_brand AS book, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '\\d+') AS INT)) AS INT) AS pos FROM b""",
    "listening_minutes": "SELECT user_id, CAST(floor(sum(value) / 60) AS BIGINT) AS minutes FROM events WHERE value IS NOT NULL GROUP BY 1",
    "model_weights": f"""SELECT p_partkey, name, CASE WHEN {literal([*lexicon.FEATURE_WEIGHTS, 'unknown'])}[p_partkey % {len(lexicon.FEATURE_WEIGHTS) + 1} + 1] = name THEN p_size / 50.0::DOUBLE ELSE weight END AS weight
        FROM part, {values_sql('name string, weight double', list(lexicon.FEATURE_WEIGHTS.items()))}""",
    "shown_names": "SELECT p_partkey, p_size % 4 < 2 AS blank FROM part",
    "transfer_progress": f"""SELECT pos, 'time' AS kind, CASE WHEN starts_with(line, 'out_time=') THEN CAST(split_part(substr(line, 10), ':', 1) AS INT) * 3600 + CAST(split_part(substr(line, 10), ':', 2) AS INT) * 60 + CAST(split_part(line, ':', 3) AS DOUBLE)
               WHEN regexp_matches(line, '^out_time_(us|ms)=') THEN CAST(split_part(line, '=', 2) AS DOUBLE) / 1e6 END AS value FROM {forms_sql('line string', [(x,) for x in SECONDS_LINES])}
        UNION ALL SELECT pos, 'percent', CAST(nullif(regexp_extract(line, 'progress\\D*(\\d+)\\s*%', 1), '') AS DOUBLE) FROM {forms_sql('line string', [(x,) for x in NOTES])}""",
}

