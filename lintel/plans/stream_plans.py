"""Queries that read tables as streams, with state and timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.operators.shared import stored
from lintel.plans.tables import table
from lintel.streaming import progress, stateful

#: A run begins every hour from some day on, a turn every ten seconds; a source may lag the other's end by half a minute.
FIRST, RUN_SECONDS, TURN_SECONDS, DRAIN_SECONDS = 1_600_000_000, 3600, 10, 30
#: Reports of a stage are shown this far apart.
REPORT_SECONDS = 15


def _at(turn: Column) -> Column:
    return F.timestamp_seconds(FIRST + F.col("conv_id") * RUN_SECONDS + turn * TURN_SECONDS)


def _streamed(spark, rows: DataFrame) -> DataFrame:
    """Rows made ready once, as a stream of their files. What a stream itself joins is shuffled anew in every micro-batch, between all
    of its state's partitions."""
    return stateful.streamed_table(spark, stored(rows))


def _source(rows: DataFrame, role: str) -> DataFrame:
    """One source's turns as chunks; every third one ends its line, after a carriage return every sixth."""
    mark = F.when(F.col("turn") % 6 == 0, "\r\n").when(F.col("turn") % 3 == 0, "\n").otherwise("")
    return rows.where(F.col("role") == role).select(
        F.col("conv_id").alias("run"), F.col("nth").alias("seq"), _at(F.col("turn")).alias("at"), F.concat("text", mark).cast("binary").alias("chunk"), F.col("ended").alias("ended")
    )


def merged_line_streams(spark, sf_dir):
    """What users say and what assistants answer as two streams of chunks, merged into lines; a side that says nothing is cut."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").select("conv_id", "turn", "role", "text")
    of_role = Window.partitionBy("conv_id", "role").orderBy("turn")
    stream = _streamed(spark, turns.withColumns({"nth": F.row_number().over(of_role) - 1, "ended": F.lead("turn").over(of_role).isNull()}))
    lines = stateful.merged_lines(_source(stream, "user"), _source(stream, "assistant"), DRAIN_SECONDS)
    return stateful.drained(lines).select("run", "kind", "source", "line_no", F.unix_seconds("at").alias("at"), "line")


def _updates(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """A conversation as a stage: it starts with its first turn (but for every fifth, which began before), and finishes after the last."""
    known = rows.join(counts, "conv_id")
    kind = F.when((F.col("turn") == 0) & (F.col("conv_id") % 5 != 0), "start").when(F.col("turn") == F.col("last"), "finish").otherwise("update")
    late = _at(F.col("turn")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.length("text") % 7)
    return known.select(
        F.col("conv_id").alias("stage"), F.col("turn").alias("seq"), late.alias("at"), kind.alias("kind"),
        (F.col("turn") + 1).cast("double").alias("completed"), (F.col("last") + 1).cast("double").alias("total"), (F.col("turn") % 4 == 3).alias("force"),
    )


def report_lifecycle(spark, sf_dir):
    """Starts, throttled updates, ticks and finishes of conversations; every fifth one is known to have begun a minute before."""
    turns = table(spark, sf_dir, "conversations")
    counts = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    begun = counts.where("conv_id % 5 = 0").select(F.col("conv_id").alias("stage"), (_at(F.lit(0)) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1))).alias("start"))
    shown = stateful.reports(_streamed(spark, _updates(turns, counts)), REPORT_SECONDS, begun, ticking=True)
    return stateful.drained(shown).select("stage", "kind", F.unix_seconds("at").alias("at"), F.round("percent", 9).alias("percent"), "elapsed", F.round("eta", 9).alias("eta"))


#: Bytes of a chunk.
CHUNK_BYTES = 1000


def chunk_lines(spark, sf_dir):
    """The lines of each document, put together from chunks of its bytes that end anywhere."""
    raw = F.col("text").cast("binary")
    cuts = F.sequence(F.lit(0), F.floor(F.greatest(F.length(raw) - 1, F.lit(0)) / CHUNK_BYTES).cast("int"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.explode(cuts).alias("seq"))
    chunks = docs.select("doc_id", "seq", F.substring(raw, F.col("seq") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)).alias("chunk"))
    return progress.reassembled_lines(chunks, ["doc_id"])


QUERIES = {f.__name__: f for f in (merged_line_streams, report_lifecycle, chunk_lines)}

ORACLES = {
    "chunk_lines": """WITH l AS (SELECT doc_id, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS l FROM documents WHERE text <> '')
        SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no, regexp_replace(unnest(l), chr(13) || '$', '') AS line FROM l""",
    "merged_line_streams": f"""WITH c AS (
            SELECT conv_id AS run, turn, CASE role WHEN 'user' THEN 'out' ELSE 'err' END AS source, {FIRST} + conv_id * {RUN_SECONDS} + turn * {TURN_SECONDS} AS "at",
                   text || CASE WHEN turn % 6 = 0 THEN chr(13) || chr(10) WHEN turn % 3 = 0 THEN chr(10) ELSE '' END AS chunk
            FROM conversations WHERE role IN ('user', 'assistant')
        ), p AS (
            SELECT *, coalesce(sum(length(chunk) - length(replace(chunk, chr(10), ''))) OVER (PARTITION BY run, source ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c
        ), q AS (
            SELECT run, source, turn, "at", before, unnest(string_split(chunk, chr(10))) AS part, generate_subscripts(string_split(chunk, chr(10)), 1) - 1 AS k FROM p
        ), l AS (
            SELECT run, source, before + k AS line_no, max("at") AS "at", string_agg(part, '' ORDER BY turn, k) AS line FROM q GROUP BY 1, 2, 3
        ), e AS (
            SELECT run, count(DISTINCT source) AS n, max("at") AS "at" FROM c GROUP BY 1
        ), w AS (
            SELECT min("at") AS "at" FROM (SELECT max("at") AS "at" FROM c GROUP BY source)
        )
        SELECT run, 'line' AS kind, source, CAST(line_no AS BIGINT) AS line_no, "at", regexp_replace(line, chr(13) || '$', '') AS line FROM l WHERE line <> ''
            OR line_no < (SELECT max(m.line_no) FROM l AS m WHERE m.run = l.run AND m.source = l.source)
        UNION ALL SELECT run, 'end', NULL, NULL, "at", NULL FROM e WHERE n = 2
        UNION ALL SELECT run, 'cut', NULL, NULL, e."at" + {DRAIN_SECONDS}, NULL FROM e, w WHERE n = 1 AND e."at" + {DRAIN_SECONDS} < w."at" """,
}
