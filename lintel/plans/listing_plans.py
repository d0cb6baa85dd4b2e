"""Queries over paged listings, saved responses, requests and plug-in table functions, rendered from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.plugins import register_plugin
from lintel.operators import listings
from lintel.operators.shared import shared_folder, written
from lintel.plans.tables import table
from lintel.sources import responses, writers

#: Documents of a listing, and of a page.
LISTING, PAGE = 40, 5
LINK = "array<string>"


def _pages(spark, sf_dir) -> DataFrame:
    """Pages of listings: documents by forties, five to a page; one page in eleven is missing. link, status, items, listing and page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"doc_id div {LISTING}").alias("listing"))
    nth = F.row_number().over(Window.partitionBy("listing").orderBy("doc_id")) - 1  # forty at most
    rows = docs.select("listing", "doc_id", F.floor(nth / PAGE).cast("int").alias("page"))
    items = F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: F.concat(F.lit("d"), F.floor(i / 2).cast("string")))
    status = F.when((F.col("listing") + F.col("page")) % 11 == 7, 404).otherwise(200)
    return rows.groupBy("listing", "page").agg(items.alias("items")).withColumns({"status": status, "link": _link(F.col("page"))})


def _link(page):
    return F.concat_ws("/", F.lit("l"), F.col("listing").cast("string"), page.cast("string"))


def _starts(pages: DataFrame) -> DataFrame:
    return pages.select("listing", _link(F.lit(0)).alias("link")).distinct()


def listing_items(spark, sf_dir):
    """Listings whose pages name the next one: all items in order, repeats included, up to the first page that is missing."""
    pages = written(_pages(spark, sf_dir).withColumn("next", F.array(_link(F.col("page") + 1), _link(F.lit(0))).cast(LINK)))
    items = listings.listed_items(pages, listings.followed(pages, _starts(pages)))
    return listings.place_in_listing(items, "depth", "place", "nth").select("listing", "position", "item")


def listing_distinct(spark, sf_dir):
    """Listings whose first page names all others, in an order of its own and some of them twice: distinct items by first appearance."""
    order = sorted(range(1, LISTING // PAGE), key=lambda p: (p * 3 % 8, p))
    others = F.array(*[_link(F.lit(p)) for p in [*order, *order[:3]]]).cast(LINK)
    pages = written(_pages(spark, sf_dir).withColumn("next", F.when(F.col("page") == 0, others).otherwise(F.array(_link(F.col("page") + 1)))))
    items = listings.distinct_items(listings.listed_items(pages, listings.followed(pages, _starts(pages), most=1)))
    return listings.place_in_listing(items, "depth", "place", "nth").select("listing", "position", "item")


def offset_items(spark, sf_dir):
    """Listings read by offset until a page is empty or missing, or the total is reached that some of them say (too small for a third)."""
    rows = _pages(spark, sf_dir)
    count = F.sum(F.size("items")).over(Window.partitionBy("listing"))
    total = F.when(F.col("listing") % 3 == 1, count).when(F.col("listing") % 3 == 2, count - 7)
    paged = rows.select("listing", (F.col("page") * PAGE).alias("offset"), "status", "items", total.cast("int").alias("total"))
    pages = written(listings.offset_links(paged))
    starts = rows.select("listing", F.concat_ws("@", F.col("listing").cast("string"), F.lit("0")).alias("link")).distinct()
    items = listings.distinct_items(listings.listed_items(pages, listings.followed(pages, starts)))
    return listings.place_in_listing(items, "depth", "place", "nth").select("listing", "position", "item")


def playlist_albums(spark, sf_dir):
    """Turns as tracks of a playlist, documents as responses about tracks: the first album that a track's last response names."""
    turns = table(spark, sf_dir, "conversations")
    items = turns.select("conv_id", "turn", F.concat_ws("-", "role", (F.length("text") % 50).cast("string")).alias("track"))
    docs = table(spark, sf_dir, "documents")
    role = F.when(F.col("doc_id") % 3 == 0, "user").when(F.col("doc_id") % 3 == 1, "assistant").otherwise("system")
    albums = F.when(F.col("doc_id") % 7 == 0, F.array().cast(LINK)).otherwise(F.array(F.concat(F.lit("a"), F.col("doc_id").cast("string")), F.lit("b")))
    said = docs.select(F.concat_ws("-", role, (F.col("doc_id") % 53).cast("string")).alias("track"), F.col("doc_id").alias("response"), F.when(F.col("doc_id") % 10 == 3, 429).otherwise(200).alias("status"), albums.alias("albums"))
    return listings.first_albums(items, said).select("conv_id", "turn", "track", "album")


def _saved(spark, sf_dir) -> DataFrame:
    """Responses rendered from documents, one a line, written to the shared folder and read as a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("title"), "lang", "source")
    key = F.col("doc_id").cast("string")
    other = (F.col("doc_id") + 1).cast("string")
    link = lambda kind, i: F.struct(F.lit(kind).alias("type"), i.alias("id"))
    artists = F.struct(F.array(link("artists", F.col("source")), link("artists", F.lit("nobody")), link("artists", F.col("lang"))).alias("data"))
    facts = F.struct(F.col("title").alias("title"), F.lit("2001-02-03").alias("releaseDate"), F.struct(F.col("source").alias("text")).alias("copyright"), (F.col("doc_id") % 30).alias("numberOfItems"))
    album = F.struct(F.lit("albums").alias("type"), key.alias("id"), facts.alias("attributes"), F.struct(artists.alias("artists")).alias("relationships"))
    people = [F.to_json(F.struct(F.lit("artists").alias("type"), F.col(c).alias("id"), F.struct(F.upper(c).alias("name")).alias("attributes"))) for c in ("source", "lang")]
    included = F.concat(F.lit("["), F.concat_ws(",", *people, F.when(F.col("doc_id") % 2 == 0, F.to_json(album))), F.lit("]"))
    hits = F.struct(F.lit("searchResults").alias("type"), key.alias("id"), F.struct(F.struct(F.array(link("albums", other), link("albums", key), link("tracks", key)).alias("data")).alias("albums")).alias("relationships"))
    data = F.when(F.col("doc_id") % 2 == 0, F.to_json(hits)).otherwise(F.to_json(album))
    status = F.when(F.col("doc_id") % 13 == 5, 429).otherwise(200).cast("string")
    body = F.when(F.col("doc_id") % 19 == 4, "null").otherwise(F.concat(F.lit('{"data": '), data, F.lit(', "included": '), included, F.lit("}")))
    line = F.concat(F.lit('{"request": "r'), key, F.lit('", "status": '), status, F.lit(', "body": '), body, F.lit("}"))
    folder = f"{shared_folder(spark)}/responses-{uuid.uuid4().hex}"
    docs.select(F.when(F.col("doc_id") % 17 == 3, F.substring(line, 1, 30)).otherwise(line).alias("value")).write.text(folder)
    return responses.saved_responses(spark, folder)


def response_hits(spark, sf_dir):
    found = responses.search_hits(_saved(spark, sf_dir))
    return found.select("request", "pos", "id", "title", "release_date", F.array_join("artists", ",").alias("artists"), "copyright")


def response_details(spark, sf_dir):
    found = responses.album_details(_saved(spark, sf_dir))
    return found.select("request", "id", "title", F.array_join("artists", ",").alias("artists"), "copyright", "track_count")


def response_problems(spark, sf_dir):
    """What could not be used, by reason."""
    return _saved(spark, sf_dir).where("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("responses"))


def _streams(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.expr("doc_id div 3").alias("book"), "lang", F.when(F.length("text") > 400, F.lit("long")).otherwise("short").alias("rate"))


def uniform_parameters(spark, sf_dir):
    """Three documents as a book: whether their languages and sizes agree, and which there are."""
    groups = listings.uniform_groups(_streams(spark, sf_dir), ["book"], ["lang", "rate"])
    return groups.select("book", "uniform", "rows", F.array_join("variants", ", ").alias("variants"))


def sent_requests(spark, sf_dir):
    """Distinct ids of each source in batches of 50 as request bodies, sent to a folder twice under one job, and read again."""
    docs = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("d"), F.expr("doc_id div 2").cast("string")).alias("id"), "doc_id")
    batches = writers.request_batches(docs, ["source"], "id", "doc_id", 50)
    body = F.to_json(F.struct("source", "batch", F.transform("ids", lambda i: F.struct(F.lit("albums").alias("type"), i.alias("id"))).alias("data")))
    bodies = written(batches.select(body.alias("body")))
    folder = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    for _ in range(2):  # a retry adds nothing
        responses.send(bodies, folder, "all")
    read = responses.sent(spark, folder).select(F.from_json("body", "struct<source:string,batch:long,data:array<struct<type:string,id:string>>>").alias("b"))
    return read.select("b.source", "b.batch", F.array_join(F.transform("b.data", lambda d: d["id"]), ",").alias("ids"))


def _hits(row, state):
    """A search back end: the first five rows of a query."""
    state["n"] = state.get("n", 0) + 1
    if state["n"] <= 5:
        yield row["query"], state["n"], row["id"]


def plugin_search(spark, sf_dir):
    """A back end as a table function in SQL, over an index of documents by language and remainder."""
    register_plugin(spark, "first_hits", _hits, "query string, rank int, id long", ["query"], ["id"])
    docs = table(spark, sf_dir, "documents")
    docs.select(F.concat_ws("-", "lang", (F.col("doc_id") % 97).cast("string")).alias("query"), F.col("doc_id").alias("id")).createOrReplaceTempView("search_index")
    return spark.sql("SELECT query, rank, id FROM first_hits(TABLE(search_index))")


def _percents(row, state):
    """A line parser: percentages that are higher than all before."""
    number = row["line"].rpartition("=")[2].strip().removesuffix("%") if row["line"].startswith("progress =") else ""
    if number.isdigit() and int(number) > state.get("top", -1):
        state["top"] = int(number)
        yield row["run"], row["line_no"], float(number)
    state["run"], state["lines"] = row["run"], state.get("lines", 0) + 1


def _last(state):
    if state:
        yield state["run"], state["lines"], None


def plugin_progress(spark, sf_dir):
    """A line parser as a table function in SQL: rising percentages of a run, and how many lines it had."""
    register_plugin(spark, "rising_percents", _percents, "run long, line_no long, percent double", ["run"], ["line_no"], _last)
    turns = table(spark, sf_dir, "conversations")
    shown = F.when(F.col("turn") % 3 == 2, "note").otherwise(F.concat(F.lit("progress = "), (F.length("text") % 101).cast("string"), F.lit("%")))
    turns.select(F.col("conv_id").alias("run"), F.col("turn").alias("line_no"), shown.alias("line")).createOrReplaceTempView("progress_lines")
    return spark.sql("SELECT run, line_no, percent FROM rising_percents(TABLE(progress_lines))")


QUERIES = {
    f.__name__: f
    for f in (
        listing_items, listing_distinct, offset_items, playlist_albums, response_hits, response_details, response_problems, uniform_parameters, sent_requests,
        plugin_search, plugin_progress,
    )
}

_LISTED = f"""n AS (SELECT doc_id, doc_id // {LISTING} AS listing, (row_number() OVER (PARTITION BY doc_id // {LISTING} ORDER BY doc_id) - 1) // {PAGE} AS page FROM documents),
    p AS (SELECT listing, page, doc_id, 'd' || (doc_id // 2) AS item, (listing + page) % 11 = 7 AS missing FROM n)"""
_SAID = """d AS (SELECT *, left(coalesce(text, ''), 40) AS title FROM documents WHERE doc_id % 17 <> 3 AND doc_id % 13 <> 5 AND doc_id % 19 <> 4)"""
ORACLES = {
    "listing_items": f"""WITH {_LISTED}, b AS (SELECT listing, min(page) AS bad FROM p WHERE missing GROUP BY 1)
        SELECT listing, CAST(row_number() OVER (PARTITION BY listing ORDER BY page, doc_id) - 1 AS INT) AS position, item FROM p LEFT JOIN b USING (listing) WHERE bad IS NULL OR page < bad""",
    "listing_distinct": f"""WITH {_LISTED}, b AS (SELECT DISTINCT listing FROM p WHERE missing AND page = 0),
        f AS (SELECT listing, item, min((page > 0, page * 3 % 8, page, doc_id)) AS first FROM p WHERE NOT missing AND listing NOT IN (SELECT listing FROM b) GROUP BY 1, 2)
        SELECT listing, CAST(row_number() OVER (PARTITION BY listing ORDER BY first) - 1 AS INT) AS position, item FROM f""",
    "offset_items": f"""WITH {_LISTED}, t AS (SELECT listing, CASE listing % 3 WHEN 1 THEN count(*) WHEN 2 THEN count(*) - 7 END AS total, min(CASE WHEN missing THEN page END) AS bad FROM p GROUP BY 1),
        f AS (SELECT listing, item, min((page, doc_id)) AS first FROM p JOIN t USING (listing) WHERE (bad IS NULL OR page < bad) AND (page = 0 OR total IS NULL OR page * {PAGE} < total) GROUP BY 1, 2)
        SELECT listing, CAST(row_number() OVER (PARTITION BY listing ORDER BY first) - 1 AS INT) AS position, item FROM f""",
    "playlist_albums": """WITH r AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'system' END || '-' || (doc_id % 53) AS track, max(doc_id) AS last FROM documents WHERE doc_id % 10 <> 3 GROUP BY 1)
        SELECT conv_id, turn, role || '-' || (length(text) % 50) AS track, 'a' || last AS album FROM conversations JOIN r ON role || '-' || (length(text) % 50) = track WHERE last % 7 <> 0""",
    "response_hits": f"""WITH {_SAID} SELECT 'r' || doc_id AS request, 1 AS pos, CAST(doc_id AS VARCHAR) AS id, title, '2001-02-03' AS release_date, upper(source) || ',' || upper(lang) AS artists,
        '{{"text":"' || source || '"}}' AS copyright FROM d WHERE doc_id % 2 = 0""",
    "response_details": f"""WITH {_SAID} SELECT 'r' || doc_id AS request, CAST(doc_id AS VARCHAR) AS id, title, upper(source) || ',' || upper(lang) AS artists, '{{"text":"' || source || '"}}' AS copyright,
        CAST(doc_id % 30 AS INT) AS track_count FROM d WHERE doc_id % 2 = 1""",
    "response_problems": """SELECT CASE WHEN doc_id % 17 = 3 THEN 'not JSON' WHEN doc_id % 13 = 5 THEN 'status 429' ELSE 'no body' END AS problem, count(*) AS responses FROM documents
        WHERE doc_id % 17 = 3 OR doc_id % 13 = 5 OR doc_id % 19 = 4 GROUP BY 1""",
    "uniform_parameters": """WITH s AS (SELECT doc_id // 3 AS book, coalesce(lang, '-') || '/' || CASE WHEN length(text) > 400 THEN 'long' ELSE 'short' END AS v FROM documents)
        SELECT book, count(DISTINCT v) = 1 AS uniform, count(*) AS rows, string_agg(DISTINCT v, ', ' ORDER BY v) AS variants FROM s GROUP BY 1""",
    "sent_requests": """WITH f AS (SELECT source, 'd' || (doc_id // 2) AS id, min(doc_id) AS o FROM documents GROUP BY 1, 2), n AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY o) - 1) // 50 AS batch FROM f)
        SELECT source, batch, string_agg(id, ',' ORDER BY o) AS ids FROM n GROUP BY 1, 2""",
    "plugin_search": """SELECT lang || '-' || (doc_id % 97) AS query, CAST(row_number() OVER w AS INT) AS rank, doc_id AS id FROM documents WINDOW w AS (PARTITION BY lang, doc_id % 97 ORDER BY doc_id) QUALIFY row_number() OVER w <= 5""",
    "plugin_progress": """WITH l AS (SELECT conv_id AS run, turn AS line_no, CASE WHEN turn % 3 <> 2 THEN length(text) % 101 END AS p FROM conversations),
        r AS (SELECT *, max(p) OVER (PARTITION BY run ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM l)
        SELECT run, line_no, CAST(p AS DOUBLE) AS percent FROM r WHERE p > coalesce(top, -1) UNION ALL SELECT run, count(*), NULL FROM l GROUP BY 1""",
}
