"""Lenient and strict readings of JSON values, as columns of variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _plain(value: Column) -> Column:
    """The text of a scalar, trimmed; null and blank text are null."""
    return F.nullif(F.trim(F.try_variant_get(value, "$", "string")), F.lit(""))


def string_list(value: Column) -> Column:
    """A list's texts without nulls and blanks; a scalar as a list of one. What is false, zero or empty gives none."""
    items = F.try_variant_get(value, "$", "array<variant>")
    listed = F.filter(F.transform(items, _plain), lambda s: s.isNotNull())
    false = (_kind(value) == "BOOLEAN") & ~F.coalesce(F.try_variant_get(value, "$", "boolean"), F.lit(False))
    zero = F.coalesce(F.try_variant_get(value, "$", "double") == 0, F.lit(False)) & (_kind(value) != "STRING")
    one = F.filter(F.array(_plain(value)), lambda s: s.isNotNull())
    none = F.array().cast("array<string>")
    return F.when(value.isNull() | F.is_variant_null(value) | false | zero, none).when(_kind(value) == "ARRAY", listed).otherwise(one)


def text_list(value: Column) -> Column:
    """The older reading: nulls in a list become the text 'None', and of scalars only text counts."""
    items = F.try_variant_get(value, "$", "array<variant>")
    listed = F.transform(items, lambda v: F.when(F.is_variant_null(v), F.lit("None")).otherwise(F.trim(F.try_variant_get(v, "$", "string"))))
    own = F.when(_kind(value) == "STRING", F.filter(F.array(_plain(value)), lambda s: s.isNotNull())).otherwise(F.array().cast("array<string>"))
    return F.when(value.isNull(), F.array().cast("array<string>")).when(_kind(value) == "ARRAY", F.filter(listed, lambda s: s != "")).otherwise(own)


def float_map(value: Column) -> Column:
    """An object's values as numbers; one that is no number raises with its key. What is no object gives an empty map."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))

    def number(entry: Column) -> Column:
        text = F.try_variant_get(entry["value"], "$", "string")
        found = F.when(_kind(entry["value"]) == "BOOLEAN", F.try_variant_get(entry["value"], "$", "boolean").cast("double")).otherwise(F.trim(text).try_cast("double"))
        bad = F.raise_error(F.concat(F.lit("features["), entry["key"], F.lit("] must be a number, got "), F.coalesce(text, F.lit("null")))).cast("double")
        return F.struct(entry["key"].alias("key"), F.coalesce(found, bad).alias("value"))

    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:double>>"))
    return F.when(_kind(value) == "OBJECT", F.map_from_entries(F.transform(entries, number))).otherwise(empty)


def path_and_query(path: Column) -> tuple[Column, Column]:
    """Path with a leading slash, and its query as a map in which the last of repeated names counts; blank values are none."""
    absolute = path.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]")
    bare = F.when(absolute, F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")).otherwise(path)
    bare = F.when(absolute, F.regexp_replace(bare, "#.*$", "")).otherwise(bare)
    raw = F.substring_index(bare, "?", 1)
    query = F.when(F.contains(bare, F.lit("?")), F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise("")
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=."))
    decoded = F.transform(pairs, lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("k"), F.url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    names = F.array_distinct(F.transform(decoded, lambda p: p["k"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(decoded, lambda p: p["k"] == n), -1)["v"])
    return F.when(F.startswith(raw, F.lit("/")), raw).otherwise(F.concat(F.lit("/"), raw)), F.map_from_arrays(names, last)
