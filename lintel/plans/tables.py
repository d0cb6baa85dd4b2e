"""Tables of the driver and inline fixtures, for Spark and for SQL alike."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value: object) -> str:
    """A value in SQL that Spark and DuckDB both read."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]"
    return str(value)


def values_sql(columns: str, rows: list[tuple]) -> str:
    """Rows as a derived table for DuckDB; columns as 'name type, ...' in Spark's type names."""
    names = [c.strip().split()[0] for c in columns.split(", ")]
    kinds = [{"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "array<string>": "VARCHAR[]", "date": "DATE"}.get(k := c.strip().split()[1], k.upper()) for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(f"CAST({literal(v)} AS {k})" for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(names)}))"


def fixture(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    dates = [c.strip().split()[0] for c in columns.split(", ") if c.strip().endswith(" date")]
    df = spark.createDataFrame(rows, columns.replace(" date", " string"))
    return df.withColumns({c: df[c].cast("date") for c in dates})


# Texts rendered from documents. In a form, {n} stands for a number of three digits of the document and {w} for its first word of
# ASCII letters.
_WORD = "[A-Za-z]{3,12}"
_DOCUMENTS = f"(SELECT doc_id, CAST(doc_id % 900 + 100 AS VARCHAR) AS _n, coalesce(nullif(regexp_extract(coalesce(text, ''), '{_WORD}'), ''), 'Word') AS _w FROM documents)"


def _split(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split()) for c in columns.split(", ")]


def listed(columns: str, rows: list[tuple]) -> Column:
    """Rows as an array of structs."""
    kind = "array<struct<" + ",".join(f"`{name}`:{kind.replace('long', 'bigint')}" for name, kind in _split(columns)) + ">>"
    return F.from_json(F.lit(json.dumps([dict(zip([c for c, _ in _split(columns)], r, strict=True)) for r in rows])), kind)


def _filled(value: Column, kind: str) -> Column:
    fill = lambda x: F.replace(F.replace(x, F.lit("{n}"), F.col("_n")), F.lit("{w}"), F.col("_w"))
    return fill(value) if kind == "string" else F.transform(value, fill) if kind == "array<string>" else value


def _filled_sql(name: str, kind: str) -> str:
    fill = "replace(replace({x}, '{{n}}', _n), '{{w}}', _w)"
    if kind == "string":
        return fill.format(x=f'"{name}"') + f' AS "{name}"'
    return (f'list_transform("{name}", lambda x: ' + fill.format(x="x") + f') AS "{name}"') if kind == "array<string>" else f'"{name}"'


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), _WORD, 0), F.lit("")), F.lit("Word"))
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 900 + 100).cast("string").alias("_n"), word.alias("_w"))


def forms(spark: SparkSession, sf_dir: str, columns: str, rows: list[tuple], key: str = "pos") -> DataFrame:
    """A row for each document, whose id is the key: one of the forms in turn, filled with the document's values."""
    made = _documents(spark, sf_dir).withColumn("_f", F.element_at(listed(columns, rows), (F.col("doc_id") % len(rows) + 1).cast("int")))
    return made.select(F.col("doc_id").alias(key), *[_filled(F.col("_f").getField(c), kind).alias(c) for c, kind in _split(columns)])


def forms_sql(columns: str, rows: list[tuple], key: str = "pos") -> str:
    """DuckDB: the same as a derived table; also for the results that forms have."""
    listed = values_sql(f"_k int, {columns}", [(k, *r) for k, r in enumerate(rows)])
    listed = listed.replace(f"t(_k, {', '.join(c for c, _ in _split(columns))})", "t(_k, " + ", ".join(f'"{c}"' for c, _ in _split(columns)) + ")")
    return f'(SELECT doc_id AS "{key}", {", ".join(_filled_sql(c, kind) for c, kind in _split(columns))} FROM {_DOCUMENTS} AS d JOIN {listed} AS f ON f._k = doc_id % {len(rows)})'


def copies(spark: SparkSession, sf_dir: str, columns: str, rows: list[tuple]) -> DataFrame:
    """All rows for each document, filled with its values; their first column, a name, gets the document's id."""
    made = _documents(spark, sf_dir).select("doc_id", "_n", "_w", F.explode(listed(columns, rows)).alias("_f"))
    (key, _), *rest = _split(columns)
    name = F.concat_ws("-", F.col(f"_f.{key}").cast("string"), F.col("doc_id").cast("string"))
    return made.select(name.alias(key), *[_filled(F.col("_f").getField(c), kind).alias(c) for c, kind in rest])


def copies_sql(columns: str, rows: list[tuple]) -> str:
    """DuckDB: the same as a derived table; also for the results that copies have."""
    (key, _), *rest = _split(columns)
    return f'(SELECT "{key}" || \'-\' || doc_id AS "{key}", {", ".join(_filled_sql(c, kind) for c, kind in rest)} FROM {_DOCUMENTS} AS d, {values_sql(columns, rows)} AS f)'


def norm(x: str) -> str:
    """DuckDB: normalised text."""
    return f"trim(regexp_replace(lower(regexp_replace(strip_accents(translate(coalesce({x}, ''), '’‘“”', '    ')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def words(x: str, least: int = 1, stop: list[str] | None = None) -> str:
    """DuckDB: words of normalised text of a least length that are no stopwords."""
    keep = f" AND NOT list_contains({literal(stop)}, w)" if stop else ""
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: length(w) >= {least}{keep})"


def distinct(x: str) -> str:
    """DuckDB: distinct list items, sorted."""
    return f"list_sort(list_distinct({x}))"
