"""Records of decisions: their ids and parts, what is read back from them, and pages of catalogue resources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lintel.functions import json_values, text
from lintel.operators.runs import first_of_each

#: States of a choice that name an entry.
CHOSEN = ("selected", "auto_selected")


@F.pandas_udf(StringType())
def percent_text(values: pd.Series) -> pd.Series:
    """A fraction as a signed percentage of two digits, rounded as its exact binary value is."""
    return values.map(lambda v: None if pd.isna(v) else f"{v * 100:+.2f}%")


@F.pandas_udf(ArrayType(StringType()))
def _two_digits(values: pd.Series) -> pd.Series:
    return values.map(lambda row: None if row is None else [f"{v:.2f}" for v in row])


def feature_text(df: DataFrame, key: str, features: str) -> DataFrame:
    """key and each row's features above zero as 'name=0.00' by name, or '(no signals)'; rows that share a key stay apart."""
    shown = F.array_sort(F.filter(F.map_entries(features), lambda e: e["value"] > 0))
    rows = df.select(F.col(key).alias("_key"), F.coalesce(shown, F.array().cast("array<struct<key:string,value:double>>")).alias("_shown"))
    numbers = _two_digits(F.transform("_shown", lambda e: e["value"]))
    said = F.array_join(F.zip_with(F.transform("_shown", lambda e: e["key"]), numbers, lambda k, v: F.concat(k, F.lit("="), v)), " ")
    return rows.select(F.col("_key").alias(key), F.coalesce(F.nullif(said, F.lit("")), F.lit("(no signals)")).alias("features"))


def record_id(file: Column, line: Column, title: Column) -> Column:
    return F.concat_ws("|", F.coalesce(file, F.lit("")), F.coalesce(line, F.lit(0)).cast("string"), F.coalesce(title, F.lit("")))


def source_payload(file: Column, line: Column, raw: Column, subsection: Column, context: Column) -> Column:
    return F.struct(file.alias("file"), line.alias("line"), raw.alias("raw"), subsection.alias("subsection"), context.alias("context"))


def records(albums: DataFrame, ranked: DataFrame, choices: DataFrame, mode: str, top: int = 5) -> DataFrame:
    """One record an album: its id, source, the best candidates, the choice, and what a reviewer sees.

    albums: album_id, file, line, raw, subsection, context, title. ranked: album_id, id, rank, score,
    release_date. choices: album_id, id (null: none), reason.
    """
    best = ranked.where(F.col("rank") <= top).groupBy("album_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("top_candidates"))
    first = ranked.where("rank = 1").select("album_id", F.round("score", 3).alias("top_score"), text.year_in(F.col("release_date")).alias("top_release_year"))
    count = ranked.groupBy("album_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    picks = choices.select("album_id", F.col("id").alias("chosen_id"), "reason")
    status = F.when(F.coalesce("chosen_id", F.lit("")) != "", "auto_selected").otherwise("needs_review")
    source = source_payload(*[F.col(c) for c in ("file", "line", "raw", "subsection", "context")])
    joined = albums.join(best, "album_id", "left").join(first, "album_id", "left").join(count, "album_id", "left").join(picks, "album_id", "left")
    review = F.struct(
        F.lit(mode).alias("mode"),
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        F.coalesce("top_release_year", F.lit("")).alias("top_release_year"),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.coalesce("reason", F.lit("")).alias("auto_reason"),
    )
    return joined.select(
        record_id(F.col("file"), F.col("line"), F.col("title")).alias("record_id"), source.alias("source"), "album_id", "top_candidates", F.col("chosen_id"), status.alias("status"), review.alias("review")
    )


def link_updates(rows: DataFrame) -> DataFrame:
    """source_line, id and title of records whose choice stands, from the last line of a file to the first.

    rows: file, source_line, status, id, title.
    """
    chosen = rows.where(F.col("status").isin(*CHOSEN)).select("file", "source_line", F.trim("id").alias("id"), F.trim(F.coalesce("title", F.lit(""))).alias("title"))
    good = chosen.where((F.col("id") != "") & (F.coalesce("source_line", F.lit(0)) > 0))
    return good.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy(F.col("source_line").desc(), "id")))


def cached_queries(rows: DataFrame, key: str) -> DataFrame:
    """key, pos, template and query: kept query candidates, or else kept queries, or else what the candidates were found by.

    rows: key, query_candidates (array of template and query), queries (array), candidate_queries (array of arrays).
    """

    def some(values: Column) -> Column:
        return F.coalesce(F.size(values), F.lit(0)) > 0

    def cached(values: Column) -> Column:
        said = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda q: F.coalesce(q, F.lit("")) != "")
        return F.transform(said, lambda q: F.struct(F.lit("cached").alias("template"), q.alias("query")))

    found = cached(F.array_distinct(F.flatten(F.filter("candidate_queries", lambda q: q.isNotNull()))))
    picked = F.when(some(F.col("query_candidates")), F.col("query_candidates")).when(some(F.col("queries")), cached(F.col("queries"))).otherwise(found)
    return rows.select(key, F.posexplode(picked).alias("pos", "q")).select(key, "pos", "q.template", "q.query")


def page_tracks(pages: DataFrame, key: str, json: str) -> tuple[DataFrame, DataFrame]:
    """Distinct track ids of page documents in order (key, pos, id), and the paths at which their lists go on (key, pos, path)."""
    root = pages.select(key, F.try_parse_json(json).alias("v"))

    def listed(value: Column, path: str) -> Column:
        return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))

    nested = F.flatten(F.transform(listed(F.col("v"), "$.rows"), lambda r: listed(r, "$.modules")))
    modules = F.filter(F.concat(listed(F.col("v"), "$.modules"), nested), lambda m: F.try_variant_get(m, "$.type", "string") == "ALBUM_ITEMS")
    entries = F.concat(listed(F.col("v"), "$.items"), F.flatten(F.transform(modules, lambda m: F.concat(listed(m, "$.pagedList.items"), listed(m, "$.items")))))
    inner = F.try_variant_get("e", "$.item", "variant")
    item = F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner).otherwise(F.col("e"))
    rows = root.select(key, F.posexplode(entries).alias("pos", "e")).where(F.schema_of_variant("e").startswith("OBJECT"))
    kind = F.coalesce(F.nullif(F.try_variant_get("e", "$.type", "string"), F.lit("")), F.nullif(F.try_variant_get(item, "$.type", "string"), F.lit("")))
    ids = rows.where(kind.isNull() | (kind == "track")).select(key, "pos", F.try_variant_get(item, "$.id", "string").alias("id")).where("id <> '' AND id <> '0'")
    paths = root.select(key, F.posexplode(F.transform(modules, lambda m: F.try_variant_get(m, "$.pagedList.dataApiPath", "string"))).alias("pos", "path"))
    return first_of_each(ids, [key, "id"], "pos"), paths.where("path <> ''")


def longest_listing(listings: DataFrame, key: str, expected: str = "expected") -> DataFrame:
    """key and ids: the first source's list if it is as long as expected, else the next that is longer, and so on.

    listings: key, source (order of trust), ids, expected (null: any list that is not empty will do).
    """
    sized = listings.withColumn("n", F.size("ids"))
    before = Window.partitionBy(key).orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    enough = (F.col("n") > 0) & (F.col(expected).isNull() | (F.col("n") >= F.col(expected)))
    asked = sized.withColumn("_done", F.max(enough.cast("int")).over(before)).where("coalesce(_done, 0) = 0")
    return first_of_each(asked, [key], F.col("n").desc(), "source").select(key, "source", "ids")


def with_name(lists: DataFrame, asked: DataFrame, name: str = "name") -> DataFrame:
    """The listed rows that bear exactly an asked name."""
    return lists.join(asked.select(name).distinct(), name, "left_semi")


def first_value(cells: DataFrame, keys: list[str], order: str, value: str, header: str) -> DataFrame:
    """The first cell of each key that is neither blank nor its own header, trimmed; empty where there is none."""
    shown = F.trim(F.coalesce(F.col(value).cast("string"), F.lit("")))
    told = cells.withColumn("_shown", F.when((shown != "") & (F.lower(shown) != F.lit(header.lower())), shown))
    first = first_of_each(told.where("_shown IS NOT NULL"), keys, order).select(*keys, F.col("_shown").alias("first"))
    return cells.select(*keys).distinct().join(first, keys, "left").select(*keys, F.coalesce("first", F.lit("")).alias("first"))


def head_rows(rows: DataFrame, keys: list[str], order: str, most: int = 3) -> DataFrame:
    """The first rows of each key, its header among them."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def listed_words(values: Column) -> Column:
    """Words of texts that are apart by commas or space, in order."""
    split = F.transform(values, lambda v: F.filter(F.split(F.trim(F.replace(v, F.lit(","), F.lit(" "))), r"\s+"), lambda w: w != ""))
    return F.flatten(split)


def books(files: DataFrame, audio: tuple[str, ...], output_dir: str | None = None, named: str | None = None) -> DataFrame:
    """book and pos: folders (of files: folder, name) that hold audio, but the output folder, in natural order."""
    ends = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    found = files.where(ends.isin(*audio)).select(F.col("folder").alias("book")).distinct()
    if output_dir is not None:
        found = found.where(F.col("book") != output_dir)
    if named:
        found = found.where(F.contains(F.lower(F.element_at(F.split("book", "/"), -1)), F.lit(named.lower())))
    parent = F.regexp_extract("book", r"^(.*)/[^/]*$", 1)
    return found.select("book", F.row_number().over(Window.partitionBy(parent).orderBy(text.natural_key(F.col("book")), "book")).alias("pos"))


def whole_minutes(durations: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Whole minutes of the sum of a key's seconds; the sum is of decimals, so that it does not hang on the order of rows.

    Where a key has values that no decimal of nine places holds, its sum is one of doubles.
    """
    exact = F.col(seconds).try_cast("decimal(28,9)")
    sums = durations.groupBy(*keys).agg(F.sum(exact).alias("_exact"), F.sum(seconds).alias("_plain"), (F.count_if(exact == F.col(seconds)) == F.count(seconds)).alias("_fits"))
    whole = sums.withColumn("_whole", F.floor("_exact"))
    minutes = F.when(F.col("_fits"), F.expr("(_whole - pmod(_whole, 60)) div 60")).otherwise(F.floor(F.col("_plain") / 60).cast("long"))
    return whole.select(*keys, minutes.alias("minutes"))


def read_lists(rows: DataFrame, json: str) -> DataFrame:
    """The rows with strings and texts, the two readings of a JSON value as a list."""
    return rows.withColumn("_v", F.try_parse_json(json)).withColumns({"strings": json_values.string_list(F.col("_v")), "texts": json_values.text_list(F.col("_v"))}).drop("_v")
