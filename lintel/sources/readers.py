"""Readers with explicit schemas and ordinals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.functions import lexicon, text
from lintel.operators.runs import first_of_each
from lintel.sources.mail import mail_html

CANDIDATE = "struct<id:string,title:string,artists:array<string>,release_date:string,copyright:string,track_count:int,score:double,features:map<string,double>,queries:array<string>,details_fetched:boolean>"
ALBUM = "struct<title:string,composers:array<string>,performers:array<string>,ensembles:array<string>,conductor:string,label:string,year:string,works:array<string>,instruments:array<string>>"
SOURCE = "struct<file:string,line:int,raw:string,subsection:string,context:map<string,string>>"


def truth_schema(id_field: str) -> str:
    """Schema of truth records; the catalogue's name for its ids is ``id_field``."""
    return (
        f"record_id string, source {SOURCE}, album {ALBUM}, queries array<string>, query_candidates array<struct<template:string,query:string>>,"
        f" candidates array<{CANDIDATE}>, top_candidates array<{CANDIDATE}>, chosen {CANDIDATE},"
        f" choice struct<status:string,{id_field}:string,selected_at:string,manual:boolean>, review variant, meta variant"
    )


AUDIO = ("m4a", "m4b", "mp3", "flac", "wav", "aac", "ogg", "opus")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no and line of text files. Files are read whole each, so that lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r\n", "\n").alias("t"))
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("t", "\n$", ""), "\n")).alias("n", "line")).select("file", (F.col("n") + 1).alias("line_no"), "line")


def daily_rates(spark: SparkSession, path: str) -> DataFrame:
    """rate_date, currency and rate of an XML history of nested Cube elements, with 1.0 for EUR on every date."""
    schema = "Cube struct<Cube:array<struct<_time:string,Cube:array<struct<_currency:string,_rate:string>>>>>"
    days = spark.read.format("xml").option("rowTag", "gesmes:Envelope").schema(schema).load(path).select(F.explode("Cube.Cube").alias("d"))
    rates = days.select(F.col("d._time").try_cast("date").alias("rate_date"), F.explode("d.Cube").alias("c")).select("rate_date", F.upper("c._currency").alias("currency"), F.col("c._rate").try_cast("double").alias("rate"))
    good = rates.where("rate_date IS NOT NULL AND rate IS NOT NULL")
    return good.unionByName(good.select("rate_date").distinct().select("rate_date", F.lit("EUR").alias("currency"), F.lit(1.0).alias("rate")))


def albums(spark: SparkSession, path: str) -> DataFrame:
    """pos, source and album of a JSON array (or an object with 'albums') of albums, nested or flat; what is no object goes."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.albums", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    items = raw.select(F.posexplode(listed).alias("pos", "i")).where(F.schema_of_variant("i").startswith("OBJECT"))
    nested = F.try_variant_get("i", "$.album", "variant")
    return items.select("pos", F.from_json(F.to_json(F.try_variant_get("i", "$.source", "variant")), SOURCE).alias("source"), F.from_json(F.to_json(F.coalesce(nested, F.col("i"))), ALBUM).alias("album"))


def truth_records(spark: SparkSession, path: str, id_field: str) -> DataFrame:
    """Records of a JSON array; a malformed file raises. The last of records with one id counts."""
    rows = spark.read.schema(truth_schema(id_field)).json(path, multiLine=True, mode="FAILFAST").withColumn("pos", F.monotonically_increasing_id())
    return first_of_each(rows, ["record_id"], F.col("pos").desc())


def chosen_ids(records: DataFrame, id_field: str) -> DataFrame:
    """record_id, chosen_id and chosen_title of records: the choice's id or else the chosen candidate's, likewise the title."""
    own, found = F.nullif(F.trim(F.col(f"choice.{id_field}")), F.lit("")), F.nullif(F.col("chosen.id"), F.lit(""))
    return records.select("record_id", F.coalesce(own, found).alias("chosen_id"), F.coalesce(F.nullif(F.col("chosen.title"), F.lit("")), F.col("album.title")).alias("chosen_title"))


def overlaid(defaults: dict[str, float], overlay: Column) -> Column:
    """Default weights with known keys replaced from a map."""
    base = text.lookup(defaults)
    return F.transform_values(base, lambda k, v: F.coalesce(F.try_element_at(overlay, k), v))


def training_model(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row of weights and template_weights: the defaults, with known keys replaced from a JSON model where there is one."""
    kept = "struct<weights:map<string,double>,template_weights:map<string,double>>"
    if path is None:
        raw = spark.range(1).select(F.lit(None).cast(kept).alias("m"))
    else:
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kept, {"mode": "FAILFAST"}).alias("m"))
    return raw.select(overlaid(lexicon.FEATURE_WEIGHTS, F.col("m.weights")).alias("weights"), overlaid(lexicon.TEMPLATE_WEIGHTS, F.col("m.template_weights")).alias("template_weights"))


def tickers(lines: DataFrame, line: str = "line", header: tuple[str, ...] = ("ticker", "symbol")) -> DataFrame:
    """Distinct tickers of lines in order: the first field of CSV or the first word, without comments and header words."""
    bare = F.trim(F.regexp_replace(line, "#.*$", ""))
    first = F.trim(F.element_at(F.split(bare, r"[,\s]+"), 1))
    rows = lines.select("line_no", first.alias("ticker")).where((F.col("ticker") != "") & ~F.lower("ticker").isin(*header))
    return first_of_each(rows, ["ticker"], "line_no")


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, length and pos of the audio files of each folder in natural order; hidden files go."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))
    kept = files.where(F.lower("name").rlike(rf"\.({'|'.join(AUDIO)})$") & ~F.startswith("name", F.lit(".")))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(folder).orderBy(text.natural_key(F.col("name")), "name")))


def first_markdown(full: Column, own: Column, pages: Column) -> Column:
    """The first of a whole text, a text and the joined texts of pages that is not blank."""
    joined = F.array_join(F.filter(F.transform(pages, lambda p: F.trim(p)), lambda p: p != ""), "\n\n")
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in (full, own, joined)])


def mail_pages(spark: SparkSession, path: str) -> DataFrame:
    """file and html: the first HTML part of MIME archives of pages."""
    return mail_html(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"), "file", "content")


def truncated_items(raw: DataFrame, key: str, json: str) -> DataFrame:
    """key, pos and item (JSON text) of JSON arrays, those cut off included: items up to the last whole one."""
    import json as codec

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = codec.JSONDecoder()
        for batch in batches:
            out = []
            for k, said in zip(batch[key], batch["_json"], strict=True):
                said = (said or "").strip()
                at, pos = 1, 0
                while said.startswith("[") and at < len(said):
                    at += len(said[at:]) - len(said[at:].lstrip(" \t\r\n,"))
                    try:
                        item, at = decoder.raw_decode(said, at)
                    except ValueError:
                        break
                    out.append((k, pos, codec.dumps(item, ensure_ascii=False)))
                    pos += 1
            yield pd.DataFrame(out, columns=[key, "pos", "item"])

    kind = raw.schema[key].dataType.simpleString()
    return raw.select(key, F.col(json).alias("_json")).mapInPandas(read, f"{key} {kind}, pos int, item string")
