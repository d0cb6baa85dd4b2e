"""Queries over what readers and writers do: mails, kept searches, training within a budget, tables written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import lexicon, text
from lintel.operators import candidates, coverage, linkage
from lintel.operators.runs import top_of_each
from lintel.operators.shared import shared_folder, written
from lintel.plans.tables import copies, copies_sql, forms, forms_sql, table
from lintel.sources import readers, writers

MAIL = (
    "From: a@b\r\nMIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=\"b\"\r\n\r\n--b\r\nContent-Type: text/css\r\n\r\np { }\r\n--b\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"
    "<html><body><h2>Work {w} {n}</h2><p> </p><p><b>Player {w}</b></p><p>prose</p><p>Label: House {n}</p><h3>Second {w} piece</h3><div><p><strong>Band {n}</strong> (Small {w})</p></div><hr><h2>1999</h2>"
    "<h2>Work {w} {n}</h2><p><b>Player {w}</b></p><p>Label: House {n}</p><h2>Related Articles</h2><h2>After {w} all</h2></body></html>\r\n--b--\r\n"
)
MARKDOWN = "## Third {w} thing\nSolo {n} (Tiny Label)\n[Go](http://m/review/three)\n"
MAILED = [("m.mhtml", "Work {w} {n}", "Player {w}", "House {n}"), ("m.mhtml", "Second {w} piece", "Band {n}", "Small {w}")]
TICKERS = ["AB{n}, a note", "# comment", "ticker", "  X{w} second # comment", "", "AB{n}", "Symbol,x", "T{n}\tz"]


def mail_candidates(spark, sf_dir):
    """Each document as an archive of a page and as a Markdown file: titles, performers and labels that its headings lead to."""
    mails = copies(spark, sf_dir, "file string, content string", [("m", MAIL), ("f", MARKDOWN)])
    files = mails.select(F.concat("file", F.when(F.startswith("file", F.lit("m")), ".mhtml").otherwise(".md")).alias("file"), F.col("content").cast("binary").alias("content"))
    found = candidates.file_candidates(files)
    return found.select("file", F.col("title_hint").alias("title"), F.col("performer_hint").alias("performer"), F.col("label_hint").alias("label"))


def _kept(spark, sf_dir) -> DataFrame:
    """Documents as entries of kept records, four a record; entries recur under other titles."""
    docs = table(spark, sf_dir, "documents")
    queries = F.array("lang", F.concat_ws("-", "source", (F.col("doc_id") % 29).cast("string")), F.lit(""))
    return docs.select(F.expr("doc_id div 4").alias("record"), (F.col("doc_id") % 4).alias("place"), F.concat(F.lit("d"), (F.col("doc_id") % 500).cast("string")).alias("id"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), queries.alias("queries"))


def cached_search(spark, sf_dir):
    """A search that asks kept records: the first five entries of each query, each as it was first seen."""
    index = linkage.cached_index(_kept(spark, sf_dir), ["record", "place"])
    top = top_of_each(index, ["query"], 5, "pos", "id")
    return top.select("query", F.row_number().over(Window.partitionBy("query").orderBy("pos", "id")).alias("rank"), "id", "title")


def cached_details(spark, sf_dir):
    """What kept records tell first about an entry that is asked for; nothing about entries that they lack."""
    asked = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), (F.col("doc_id") * 7 % 600).cast("string")).alias("id"))
    return asked.join(linkage.kept_details(_kept(spark, sf_dir), ["record", "place"], "title"), "id", "left").select("doc_id", "id", "title")


def _training(spark, sf_dir):
    """Benchmark items with 4-grams as queries of three templates, the documents that hold those, and the first document with an item's start."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", text.words(text.normalize(F.col("text"))).alias("tokens"))
    grams = items.select(F.col("item_id").cast("string").alias("album_id"), F.posexplode(F.array_distinct(linkage.ngrams(F.col("tokens"), 4, 4))).alias("pos", "query"))
    asked = written(grams.withColumn("template", F.when(F.col("pos") % 5 == 0, "title").when(F.col("pos") % 5 < 3, "work").otherwise("label_title")))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.words(text.normalize(F.col("text"))).alias("tokens"))
    index = written(linkage.held_grams(docs, asked).select("query", F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id")))
    last = asked.groupBy("album_id").agg(F.max(F.struct("pos", "query")).getField("query").alias("query"))  # what holds the last words is wanted
    truth = written(last.join(index, "query").groupBy("album_id").agg(F.max("pos").cast("string").alias("truth_id")))
    return asked, index, truth


def trained_coverage(spark, sf_dir, calls: int = 60, iterations: int = 4):
    """Coverage of the benchmark's items by their own queries within a budget of calls, and the templates' weights after it."""
    asked, index, truth = _training(spark, sf_dir)
    out = coverage.train_coverage(asked, index, truth, lexicon.TEMPLATE_WEIGHTS, iterations, calls)
    rows = [(out.covered, out.total, out.calls, t, *out.stats.get(t, (0, 0)), w) for t, w in sorted(out.template_weights.items())]
    return spark.createDataFrame(rows, "covered long, total long, calls long, template string, attempts long, hits long, weight double")


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written_records(spark, sf_dir):
    """Documents written as one JSON object a line, and read again."""
    folder = _folder(spark, "records")
    writers.write_records(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.array("source", "lang").alias("tags")), folder)
    return spark.read.schema("doc_id long, text string, lang string, tags array<string>").json(folder).select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"), "lang", F.array_join("tags", "|").alias("tags"))


def written_csv(spark, sf_dir):
    """Facts of documents and their first words, quotes and commas among them, written as CSV and read again."""
    folder = _folder(spark, "csv")
    first = F.concat(F.lit('"'), F.regexp_extract("text", "[A-Za-z]{3,12}", 0), F.lit('", and, more'))
    writers.write_csv(table(spark, sf_dir, "documents").select("doc_id", first.alias("first"), "lang", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")).alias("n_chars")), folder)
    return spark.read.schema("doc_id long, first string, lang string, n_chars long").csv(folder, header=True, escape="\\")


def rate_history(spark, sf_dir):
    """Documents as days of rates in XML, a file for each envelope, written and read; a rate or a date that is none goes, EUR is added."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 4000").alias("batch"))
    day = F.when(F.col("doc_id") % 23 == 7, "no date").otherwise(F.date_format(F.date_add(F.lit("1990-01-01"), (F.col("doc_id") % 20000).cast("int")), "yyyy-MM-dd"))
    rate = lambda code, value: F.concat(F.lit(f'<Cube currency="{code}" rate="'), value, F.lit('"/>'))
    usd = F.format_string("%d.%03d", (F.col("doc_id") % 3 + 1), F.col("doc_id") % 1000)
    cube = F.concat(F.lit('<Cube time="'), day, F.lit('">'), rate("usd", usd), rate("GBP", F.when(F.col("doc_id") % 11 == 3, "n/a").otherwise("0.5")), F.lit("</Cube>"))
    days = docs.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", cube.alias("c")))), lambda x: x["c"]), "").alias("days"))
    folder = _folder(spark, "rates")
    days.select(F.concat(F.lit('<gesmes:Envelope xmlns:gesmes="g"><Cube>'), "days", F.lit("</Cube></gesmes:Envelope>")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return readers.daily_rates(spark, folder)


def ticker_list(spark, sf_dir):
    """Each document as a line of a list of tickers: the first of each."""
    return readers.tickers(forms(spark, sf_dir, "line string", [(x,) for x in TICKERS], "line_no"))


QUERIES = {
    f.__name__: f for f in (mail_candidates, cached_search, cached_details, trained_coverage, written_records, written_csv, rate_history, ticker_list)
}

_KEPT = """k AS (SELECT doc_id, 'd' || (doc_id % 500) AS id, 't' || doc_id AS title, unnest([lang, source || '-' || (doc_id % 29)]) AS query FROM documents)"""
ORACLES = {
    "mail_candidates": f"""SELECT 'm-' || split_part(file, '-', 2) || '.mhtml' AS file, title, performer, label FROM {copies_sql('file string, title string, performer string, label string', [('m', *r[1:]) for r in MAILED])}
        UNION ALL SELECT 'f-' || split_part(file, '-', 2) || '.md', title, performer, label FROM {copies_sql('file string, title string, performer string, label string', [('f', 'Third {w} thing', 'Solo {n}', 'Tiny Label')])}""",
    "cached_search": f"""WITH {_KEPT}, f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY doc_id) = 1)
        SELECT query, CAST(row_number() OVER w AS INT) AS rank, id, title FROM f WINDOW w AS (PARTITION BY query ORDER BY doc_id) QUALIFY row_number() OVER w <= 5""",
    "cached_details": """WITH f AS (SELECT 'd' || (doc_id % 500) AS id, 't' || min(doc_id) AS title FROM documents GROUP BY 1)
        SELECT doc_id, 'd' || (doc_id * 7 % 600) AS id, title FROM documents LEFT JOIN f ON f.id = 'd' || (doc_id * 7 % 600)""",
    "written_records": "SELECT doc_id, length(text) AS chars, sha256(text) AS sha, lang, source || '|' || lang AS tags FROM documents",
    "written_csv": """SELECT doc_id, '"' || regexp_extract(text, '[A-Za-z]{3,12}') || '", and, more' AS first, lang, CASE WHEN doc_id % 3 > 0 THEN n_chars END AS n_chars FROM documents""",
    "rate_history": """WITH d AS (SELECT doc_id, DATE '1990-01-01' + CAST(doc_id % 20000 AS INT) AS rate_date FROM documents WHERE doc_id % 23 <> 7),
        r AS (SELECT rate_date, 'USD' AS currency, CAST(CAST(doc_id % 3 + 1 AS VARCHAR) || '.' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS DOUBLE) AS rate FROM d UNION ALL SELECT rate_date, 'GBP', 0.5 FROM d WHERE doc_id % 11 <> 3)
        SELECT CAST(rate_date AS DATE) AS rate_date, currency, rate FROM r UNION ALL SELECT DISTINCT CAST(rate_date AS DATE), 'EUR', 1.0 FROM r""",
    "ticker_list": f"""WITH l AS (SELECT line_no, string_split_regex(trim(regexp_replace(line, '#.*$', '')), '[,\\s]+')[1] AS ticker FROM {forms_sql('line string', [(x,) for x in TICKERS], 'line_no')})
        SELECT line_no, ticker FROM l WHERE ticker <> '' AND lower(ticker) NOT IN ('ticker', 'symbol') QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY line_no) = 1""",
}
