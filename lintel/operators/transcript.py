"""Segments with speakers: attribution by overlap, relabelling, and text formats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import values
from lintel.operators.runs import with_appearance, with_runs

BREAK = "--- speaker change ---"


#: Rows of a key that meet in one cell, about.
CELL_ROWS = 4096


def _cells(rows: DataFrame, widths: DataFrame, keys: list[str]) -> DataFrame:
    """Each row once for every cell of time that it touches."""
    k = [F.col(x).alias(f"_{x}") for x in keys]
    led = rows.join(widths.select(*k, "_from", "_width"), [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in keys]).drop(*[f"_{x}" for x in keys])
    cell = lambda t: F.when(F.col("_width") > 0, F.floor((t - F.col("_from")) / F.col("_width"))).otherwise(0).cast("long")
    return led.withColumn("_cell", F.explode(F.sequence(cell(F.col("start")), cell(F.greatest("start", "end"))))).drop("_from", "_width")


def longest_overlaps(segments: DataFrame, turns: DataFrame, keys: list[str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """keys, seg_no and speaker of the turn that overlaps each segment longest, by a sweep over time; segments without one have no row.

    A key's time is cut into cells, as many as its rows fill, and a row is in every cell that it touches. A cell's rows stream
    by in order of start, so a key may hold most rows; what is held are the segments and turns that are still open. A pair
    meets in the cell where the later of the two starts, and only the best turn of each segment leaves the cell.
    """
    said = turns.schema["speaker"].dataType.simpleString()
    times = [F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")]
    own = segments.where("start < end").select(*keys, F.lit(True).alias("_asks"), F.col("seg_no").cast("long").alias("_no"), *times, F.lit(None).cast(said).alias("_speaker"))
    theirs = turns.where("start < end").select(*keys, F.lit(False).alias("_asks"), F.col("turn_no").cast("long").alias("_no"), *times, F.col("speaker").alias("_speaker"))
    both = own.unionAll(theirs)
    span = (F.max("start") - F.min("start")) / F.ceil(F.count(F.lit(1)) / F.lit(cell_rows))
    sizes = both.groupBy(*keys).agg(F.min("start").alias("_from"), span.alias("_w"), F.avg(F.col("end") - F.col("start")).alias("_a"))
    widths = sizes.select(*keys, "_from", F.when(F.col("_w") > 0, F.greatest("_w", "_a")).otherwise(0.0).alias("_width"))  # no narrower than a row is long on average
    told = _cells(both, widths, keys)
    by = [*keys, "_cell"]
    names = [*keys, "seg_no", "_overlap", "turn_no", "speaker"]

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_segments, open_turns, best = None, [], [], {}

        def ended() -> list[tuple]:
            return [(*now[:-1], seg, length, turn, speaker) for seg, (length, turn, speaker) in best.items()]

        for batch in batches:
            out = []
            for *at, asks, no, start, end, speaker in batch[[*by, "_asks", "_no", "start", "end", "_speaker"]].itertuples(index=False):
                if tuple(at) != now:
                    if now is not None:
                        out += ended()
                    now, open_segments, open_turns, best = tuple(at), [], [], {}
                others = open_turns if asks else open_segments
                others[:] = [o for o in others if o[1] > start]
                for _, o_end, o_no, o_speaker in others:
                    length = min(end, o_end) - start  # the other began before
                    seg, turn, name = (no, o_no, o_speaker) if asks else (o_no, no, speaker)
                    if seg not in best or (-length, turn) < (-best[seg][0], best[seg][1]):
                        best[seg] = (length, turn, name)
                (open_segments if asks else open_turns).append((start, end, no, speaker))
            if out:
                yield pd.DataFrame(out, columns=names)
        if now is not None and best:
            yield pd.DataFrame(ended(), columns=names)

    schema = ", ".join(f"{k} {segments.schema[k].dataType.simpleString()}" for k in keys) + f", seg_no long, _overlap double, turn_no long, speaker {said}"
    found = told.repartition(*by).sortWithinPartitions(*by, "start").mapInPandas(sweep, schema)
    best = F.min(F.struct((-F.col("_overlap")).alias("o"), "turn_no", "speaker"))
    return found.groupBy(*keys, "seg_no").agg(best.getField("speaker").alias("speaker"))


def attributed(segments: DataFrame, turns: DataFrame, keys: list[str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """Segments (keys, seg_no, start, end, ...) with the speaker of the turn (keys, turn_no, start, end, speaker) that overlaps them longest.

    The first turn wins a tie; without overlap the speaker is null. Labels count by first appearance. seg_no and turn_no are integers
    that tell the rows of a key apart.
    """
    best = longest_overlaps(segments, turns, keys, cell_rows)
    met = segments.alias("s").join(best.alias("b"), [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "seg_no"]], "left")
    found = met.select("s.*", F.col("b.speaker").alias("speaker"))
    numbered = with_appearance(found, keys, "speaker", "seg_no")
    return numbered.withColumn("label", F.when(F.col("label_no").isNotNull(), F.format_string("SPEAKER_%02d", "label_no")))


def display_name(speaker: Column, names: Column | None = None, place: Column | None = None, listed: list[str] | None = None) -> Column:
    """A speaker's name from a map, or by place of appearance from a list; the label itself if that is blank."""
    name = F.lit(None).cast("string")
    if names is not None:
        name = F.try_element_at(names, speaker)
    elif listed and place is not None:
        name = F.try_element_at(F.array(*[F.lit(x) for x in listed]), (place + 1).cast("int"))
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), speaker)


def _told(segments: DataFrame) -> DataFrame:
    return segments.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where("text <> ''")


def _joined(rows: DataFrame, keys: list[str], value: Column, order: str, mark: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["v"]), mark).alias("out"))


def plain_text(segments: DataFrame, keys: list[str], mark: str = "\n") -> DataFrame:
    return _joined(_told(segments), keys, F.col("text"), "seg_no", mark)


def subtitles(segments: DataFrame, keys: list[str], style: str = "srt") -> DataFrame:
    """SRT (numbered cues) or VTT (a header, also without cues) of each key."""
    told = _told(segments).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("seg_no")))
    mark = "," if style == "srt" else "."
    line = F.concat(values.subtitle_time(F.col("start"), mark), F.lit(" --> "), values.subtitle_time(F.col("end"), mark), F.lit("\n"), F.col("text"))
    cue = F.concat(F.col("_n").cast("string"), F.lit("\n"), line) if style == "srt" else line
    cues = _joined(told, keys, cue, "seg_no", "\n\n")
    if style == "srt":
        return cues
    every = segments.select(*keys).distinct()
    return every.join(cues, keys, "left").select(*keys, F.concat(F.lit("WEBVTT"), F.coalesce(F.concat(F.lit("\n\n"), "out"), F.lit(""))).alias("out"))


def speaker_runs(segments: DataFrame, keys: list[str], blanks_split: bool = False) -> DataFrame:
    """keys, run, speaker and the text of each run of neighbours with one speaker."""
    rows = segments if blanks_split else _told(segments)
    told = _told(with_runs(rows, keys, "speaker", "seg_no"))
    return _joined(told, [*keys, "run", "speaker"], F.col("text"), "seg_no", " ").withColumnRenamed("out", "text")


def diarized_text(segments: DataFrame, keys: list[str]) -> DataFrame:
    """'name: text' lines of runs; no name where there is no speaker."""
    line = F.when(F.coalesce("speaker", F.lit("")) == "", F.col("text")).otherwise(F.concat_ws(": ", "speaker", "text"))
    return _joined(speaker_runs(segments, keys), keys, line, "run", "\n")


def diarized_breaks(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with a marker between them."""
    return _joined(speaker_runs(segments, keys), keys, F.col("text"), "run", f"\n{BREAK}\n")


def legacy_breaks(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Every run led by a marker, the first too; blank segments end runs."""
    return _joined(speaker_runs(segments, keys, blanks_split=True), keys, F.concat(F.lit(f"{BREAK}\n"), "text"), "run", "\n")


def text_of_each(segments: DataFrame, keys: list[str], fallback: DataFrame) -> DataFrame:
    """Plain text of each key of ``fallback`` (keys, whole): its segments' lines, or the whole text trimmed where it has none."""
    told = plain_text(segments, keys)
    return fallback.join(told, keys, "left").select(*keys, F.coalesce("out", F.trim("whole"), F.lit("")).alias("out"))


FORMATS = {
    "txt": plain_text,
    "srt": subtitles,
    "vtt": lambda segments, keys: subtitles(segments, keys, "vtt"),
    "diarized": diarized_text,
    "breaks": diarized_breaks,
    "legacy": legacy_breaks,
}


def transcript_in(segments: DataFrame, keys: list[str], style: str) -> DataFrame:
    """The transcript of each key in a format by its name; an unknown name raises."""
    if style not in FORMATS:
        raise ValueError(f"unknown format: {style}")
    return FORMATS[style](segments, keys)


def segments_of_json(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Segments of transcripts whose JSON names its fields differently.

    A document is an array, or an object with segments, chunks, transcription or results, or has a
    text alone. Of the names of a field the first that is present decides; seconds, hundredths
    (t0, t1) and milliseconds (offsets) are told apart; a start of null is 0, an end before its start
    is its start; blank segments go.
    """
    doc = F.try_parse_json(F.col(json))
    parsed = rows.withColumn("_v", doc)

    def as_list(path: str) -> Column:
        return F.try_variant_get("_v", path, "array<variant>")

    lists = F.coalesce(as_list("$"), *[as_list(f"$.{k}") for k in ("segments", "chunks", "transcription", "results")])
    alone = F.try_variant_get("_v", "$.text", "string")
    whole = F.when(alone.isNotNull(), F.array(F.try_parse_json(F.to_json(F.struct(alone.alias("text"))))))
    items = parsed.select(*keys, F.posexplode(F.coalesce(lists, whole)).alias("pos", "_s"))

    def first_present(cases: list[tuple[str, float]]) -> Column:
        out = None
        for path, factor in cases:
            here = F.try_variant_get("_s", path, "variant").isNotNull()
            value = F.try_variant_get("_s", path, "double") * factor
            out = F.when(here, value) if out is None else out.when(here, value)
        return out

    start = first_present([("$.start", 1.0), ("$.t0", 0.01), ("$.ts", 1.0), ("$.offsets.from", 0.001)])
    end = first_present([("$.end", 1.0), ("$.t1", 0.01), ("$.te", 1.0), ("$.offsets.to", 0.001)])
    text = F.coalesce(*[F.try_variant_get("_s", f"$.{k}", "string") for k in ("text", "content", "utterance", "transcript")], F.try_variant_get("_s", "$", "string"))
    speaker = F.coalesce(*[F.try_variant_get("_s", f"$.{k}", "string") for k in ("speaker", "speaker_id", "label")])
    told = items.select(*keys, "pos", F.coalesce(start, F.lit(0.0)).alias("start"), end.alias("_end"), F.trim(F.coalesce(text, F.lit(""))).alias("text"), speaker.alias("speaker")).where("text <> ''")
    return told.select(*keys, "pos", "start", F.greatest(F.coalesce("_end", "start"), "start").alias("end"), "text", "speaker")
