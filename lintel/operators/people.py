"""Performers, ensembles, conductor, instruments and label of a performer line.

A line falls into parts: its bold segments if it has several, else the whole; a slash sets what
stands before it apart from the conductors after it. Every part is a row that is cleaned and told
by its place and wording, and the rows of a line come together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions import lexicon, text


def _trimmed(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")


def _before(value: Column) -> Column:
    return F.trim(F.substring_index(value, "/", 1))


def _after(value: Column) -> Column:
    return F.when(F.contains(value, F.lit("/")), F.trim(F.regexp_replace(value, "^[^/]*/", ""))).otherwise("")


def _parts(segment: Column, mark: str) -> Column:
    """side (L: before the slash, R: after it), idx, n and part of a segment."""
    left, right = _trimmed(F.split(_before(segment), ";")), _trimmed(F.split(_after(segment), mark))

    def rows(values: Column, side: str) -> Column:
        return F.transform(values, lambda p, i: F.struct(F.lit(side).alias("side"), i.alias("idx"), F.size(values).alias("n"), p.alias("part")))

    return F.concat(rows(left, "L"), rows(right, "R"))


def performer_parts(lines: DataFrame, key: str, performer_line: str = "performer_line", label_line: str = "label_line") -> DataFrame:
    """key, performers, ensembles, conductor, instruments and label; one row per key."""
    raw = F.trim(F.coalesce(performer_line, F.lit("")))
    label_text = F.coalesce(F.col(label_line), F.lit(""))
    told = lines.select(
        key,
        raw.alias("raw"),
        F.trim(F.regexp_extract(F.when(raw != "", raw).otherwise(label_text), r"\(([^)]+)\)\s*$", 1)).alias("held"),
        F.trim(F.regexp_extract(label_text, r"(?i)^label:\s*(.*)$", 1)).alias("named"),
        F.array_sort(text.instrument_set(F.regexp_extract_all(raw, F.lit("_([^_]+)_"), 1))).alias("instruments"),
    )
    bare = F.when(F.col("held") != "", F.trim(F.regexp_replace("raw", r"\([^)]+\)\s*$", ""))).otherwise(F.col("raw"))
    told = told.withColumn("bare", bare).withColumn("bold", F.regexp_extract_all("bare", F.lit(r"\*\*(.+?)\*\*"), 1))
    several = F.size("bold") > 1
    segments = told.select(key, "instruments", several.alias("several"), F.posexplode(F.when(several, F.col("bold")).otherwise(F.array("bare"))).alias("seg", "segment"))
    segments = segments.withColumn("segment", text.without_line_prefixes(F.trim("segment"))).where("segment <> ''")
    pieces = segments.withColumn("slash", F.contains("segment", F.lit("/"))).select(
        key, "instruments", "several", "seg", "slash", F.posexplode(F.when(F.col("several"), _parts(F.col("segment"), "[;,]")).otherwise(_parts(F.col("segment"), ","))).alias("at", "p")
    )
    cleaned = pieces.select(key, "several", "seg", "at", "slash", "p.side", "p.idx", "p.n", text.without_instruments(text.without_line_prefixes(F.col("p.part")), F.col("instruments")).alias("name"))
    cleaned = cleaned.where((F.col("name") != "") & ~text.normalize(F.col("name")).isin(*lexicon.SKIPPED_SEGMENTS)).withColumn("group", text.names_ensemble(F.col("name")))
    joint = F.contains("name", F.lit("&"))
    in_bold = F.when(~F.col("slash"), F.when(F.col("group"), "ensemble").otherwise("performer")).when(joint & (F.col("idx") == 0), "performers").otherwise("ensemble")
    beside = F.col("slash") & ((F.col("idx") > 0) | ((F.col("n") == 1) & (F.size(F.split("name", " ")) <= 4)))
    in_plain = F.when(joint & ~F.col("group"), "performers").when(beside | F.col("group"), "ensemble").otherwise("performer")
    kind = F.when(F.col("side") == "R", "conductor").when(F.col("several"), in_bold).otherwise(in_plain)
    named = cleaned.withColumn("kind", kind).withColumn("names", F.when(F.col("kind") == "performers", _trimmed(F.split("name", "&"))).otherwise(F.array("name")))
    collected = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg", "at", "kind", "names"))).alias("all"))

    def of(kinds: list[str]) -> Column:
        return F.flatten(F.transform(F.filter(F.coalesce("all", F.array().cast(collected.schema["all"].dataType)), lambda x: x["kind"].isin(*kinds)), lambda x: x["names"]))

    listed = told.join(collected, key, "left").select(
        key, "instruments", "held", "named", of(["performer", "performers"]).alias("p"), of(["ensemble"]).alias("e"), F.array_join(text.merge_unique(of(["conductor"])), "; ").alias("conductor")
    )
    leader = F.filter(F.array("conductor"), lambda c: c != "")
    first = listed.withColumn("performers", text.pruned(F.col("p"), F.concat("e", leader)))
    return first.select(
        key,
        "performers",
        text.pruned(F.col("e"), F.concat("performers", leader)).alias("ensembles"),
        "conductor",
        "instruments",
        F.when(F.col("held") != "", F.col("held")).otherwise(F.regexp_replace(text.plain_inline(F.col("named")), r"^[()]+|[()]+$", "")).alias("label"),
    )
