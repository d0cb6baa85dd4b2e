"""Progress lines: parsing, classifying failures, throttling, reassembly of lines, latest state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.operators.runs import running_before
from lintel.operators.shared import cut

# The wording of messages that tools print, in order of priority: pattern, kind, fixed payload.
FAILURES = (
    (r"OPENAI_API_KEY is not set", "missing_api_key", "OPENAI_API_KEY"),
    (r"Failed to load both pyannote/speaker-diarization", "missing_api_key", "HF_TOKEN"),
    (r"Whisper model not found:\s*(\S.*)$", "missing_model", None),
    (r"binary not found or not executable:\s*(?:.*/)?(\S.*)$", "missing_dependency", None),
    (r"command not found:\s*(\S.*)$|^(?!.*command not found:)(?:.*: )?([^:]*\S)\s*: command not found", "missing_dependency", None),
    (r"Missing required Python package:\s*(?:[^']*'([^']*)'.*|(\S.*))$", "missing_dependency", None),
    (r"intended for Apple Silicon Macs", "unsupported_hardware", "VibeVoice requires Apple Silicon"),
)
API_STATUS, API_DETAIL = "OpenAI API request failed (HTTP", "API error"


def parsed_progress(line: Column) -> Column:
    """stage, percent, is_start, is_finished and detail of an INFO line; null for other lines."""
    said = F.trim(line)
    message = F.regexp_replace(said, "^INFO: ", "")
    finish, start = r"^(.+) finished in \S+(?: \((.+)\))?$", r"^(.+) started(?: \((.+)\))?$"
    update, running = r"^(.+?): +(\d+(?:\.\d+)?)%,? *(.*)$", r"^(.+?): +((?:elapsed|processed) .+)$"

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(message, pattern, group), F.lit(""))

    def event(stage: Column, percent: Column, is_start: bool, is_finished: bool, detail: Column) -> Column:
        return F.struct(stage.alias("stage"), percent.cast("double").alias("percent"), F.lit(is_start).alias("is_start"), F.lit(is_finished).alias("is_finished"), detail.cast("string").alias("detail"))

    none = F.lit(None)
    return F.when(
        F.startswith(said, F.lit("INFO: ")),
        F.when(message.rlike(finish), event(part(finish, 1), none, False, True, part(finish, 2)))
        .when(message.rlike(start), event(part(start, 1), none, True, False, part(start, 2)))
        .when(message.rlike(update), event(part(update, 1), part(update, 2), False, False, part(update, 3)))
        .when(message.rlike(running), event(part(running, 1), none, False, False, part(running, 2)))
        .otherwise(event(message, none, False, False, none)),
    )


def classified_failures(lines: DataFrame, keys: list[str]) -> DataFrame:
    """kind and payload for the output lines (keys, line_no, line) of failed runs.

    The first pattern that any line matches decides, by its first line; then an API status line with
    the first detail line after it; else the whole output is the payload of 'unknown'.
    """
    said = lines.withColumn("line", F.trim("line"))
    rank = payload = kind = F.lit(None)
    for k, (pattern, name, fixed) in reversed(list(enumerate(FAILURES))):
        groups = [F.nullif(F.trim(F.regexp_extract("line", pattern, g)), F.lit("")) for g in range(1, pattern.count("(") - pattern.count("(?") + 1)]
        found = F.lit(fixed) if fixed else F.coalesce(*groups)
        hit = F.col("line").rlike(pattern) & found.isNotNull()
        rank, kind, payload = F.when(hit, k).otherwise(rank), F.when(hit, name).otherwise(kind), F.when(hit, found).otherwise(payload)
    payload = F.when(payload.rlike("^whisper") & F.col("line").rlike("binary not found"), "whisper-cpp").when(F.col("line").rlike("required Python package"), F.replace(payload, F.lit("_"), F.lit("-"))).otherwise(payload)
    status = F.contains("line", F.lit(API_STATUS))
    from pyspark.sql import Window

    own = Window.partitionBy(*keys)
    marked = said.withColumn("_status", F.min(F.when(status, F.col("line_no"))).over(own))
    detail = (F.col("line_no") > F.col("_status")) & F.startswith("line", F.lit(API_DETAIL))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    out = marked.groupBy(*keys).agg(
        F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("line_no"), kind.alias("kind"), payload.alias("payload")))).alias("m"),
        F.min(F.when(F.col("line_no") == F.col("_status"), F.regexp_replace("line", "^(Error: )?(ERROR: )?", ""))).alias("s"),
        F.min(F.when(detail, F.struct("line_no", "line"))).alias("d"),
        F.trim(F.array_join(F.transform(parts, lambda x: x["line"]), "\n")).alias("all"),
    )
    return out.select(
        *keys,
        F.when(F.col("m").isNotNull(), F.col("m.kind")).when(F.col("s").isNotNull(), "api_error").otherwise("unknown").alias("kind"),
        F.when(F.col("m").isNotNull(), F.col("m.payload")).when(F.col("s").isNotNull(), F.concat_ws(" ", "s", "d.line")).otherwise(F.col("all")).alias("payload"),
    )


def transfer_seconds(line: Column) -> Column:
    """Seconds done of a media tool's key=value progress line, or null. Both time keys hold microseconds."""
    key, value = F.substring_index(line, "=", 1), F.regexp_replace(line, "^[^=]*=", "")
    from lintel.functions.values import clock_seconds

    return F.when(key.isin("out_time_ms", "out_time_us"), value.try_cast("double") / 1_000_000).when(key == "out_time", clock_seconds(value))


def noted_percent(line: Column) -> Column:
    return F.regexp_extract(line, r"progress\D*(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")


def _stretches(updates: DataFrame, interval: float) -> DataFrame:
    """The updates with their stretch (_owner and _k), the stage's first time, and whether they open a stage."""
    ordered = updates.repartitionByRange("stage", "seq").sortWithinPartitions("stage", "seq")
    rows = cut(ordered.withColumn("_part", F.spark_partition_id()))
    tails = rows.groupBy("_part").agg(F.max(F.struct("stage", "seq", "now")).alias("t")).select("_part", "t.stage", "t.now")
    tail = {r["_part"]: (r["stage"], r["now"]) for r in tails.collect()}  # a row for each partition, as are all below
    parts = sorted(tail)
    before = {p: tail[q] for q, p in zip(parts, parts[1:], strict=False)}

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, k, first = None, 0, float("nan")
        for batch in batches:
            if not len(batch):
                continue
            stage, now = batch["stage"].to_numpy(object), batch["now"].to_numpy(float)
            last = last or before.get(int(batch["_part"].iloc[0]), (None, 0.0))
            opens = stage != np.concatenate([[last[0]], stage[:-1]])
            due = opens | batch["force"].to_numpy(bool) | (now - np.concatenate([[last[1]], now[:-1]]) >= interval)
            firsts = pd.Series(np.where(opens, now, np.nan)).ffill().fillna(first).to_numpy()
            numbers = k + np.cumsum(due)
            yield batch.assign(_k=numbers, _first=firsts, _opens=opens)
            last, k, first = (stage[-1], now[-1]), int(numbers[-1]), firsts[-1]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", _k long, _first double, _opens boolean"
    marked = cut(rows.mapInPandas(mark, schema)).withColumn("_first", F.nanvl("_first", F.lit(None).cast("double")))
    ends = marked.groupBy("_part").agg(F.max("_k").alias("k"), F.max_by("_first", F.struct("stage", "seq")).alias("first"))
    found = {r["_part"]: r for r in ends.collect()}
    carried, owner, number, first = [], 0, 0, None
    for p in parts:
        carried.append((p, owner, number, first))
        owner, number = (p, found[p]["k"]) if found[p]["k"] else (owner, number)
        first = first if found[p]["first"] is None else found[p]["first"]
    led = marked.join(F.broadcast(updates.sparkSession.createDataFrame(carried, "_part int, _o int, _n long, _f double")), "_part", "left")
    goes_on = F.col("_k") == 0
    return led.select(
        *updates.columns,
        F.when(goes_on, F.col("_o")).otherwise(F.col("_part")).alias("_owner"),
        F.when(goes_on, F.col("_n")).otherwise(F.col("_k")).alias("_k"),
        F.coalesce("_first", "_f").alias("_first"),
        "_opens",
    )


def throttled(updates: DataFrame, interval: float) -> DataFrame:
    """Updates (stage, seq, now, completed, total, force) that are due: forced, or an interval after the last one shown.

    Works on streams and tables alike, if a stage's clock never falls. On a stream state is kept per stage. A table is
    sorted by stage and time in range partitions and falls into stretches, each of which begins where an update is due
    whatever came before: it is forced, or comes an interval after the one before it. Stretches are folded on
    their own, so that a stage may fill the table; what goes on from one partition to the next is one row each.
    """
    interval = max(0.5, interval)
    out = "stage string, seq long, now double, percent double, elapsed double, eta double"

    def fold(rows: pd.DataFrame, first: float | None, last: float) -> tuple[pd.DataFrame, float, float]:
        rows = rows.sort_values("seq")
        now, forced = rows["now"].to_numpy(float), np.flatnonzero(rows["force"].to_numpy(bool))
        if not len(now):
            return pd.DataFrame(columns=[c.split()[0] for c in out.split(", ")]), first, last
        first = float(now[0]) if first is None else first
        # from one update shown to the next: the first that comes an interval later, or the next forced one before it
        shown, at, turn = [], 0, 0
        while at < len(now):
            late = max(at, int(np.searchsorted(now, last + interval)))
            while late > at and now[late - 1] - last >= interval:  # sums and differences round differently
                late -= 1
            while late < len(now) and now[late] - last < interval:
                late += 1
            turn += int(np.searchsorted(forced[turn:], at))
            late = min(late, int(forced[turn])) if turn < len(forced) else late
            if late >= len(now):
                break
            shown.append(late)
            last, at = float(now[late]), late + 1
        completed, total = (rows[c].to_numpy(float, na_value=np.nan)[shown] for c in ("completed", "total"))
        elapsed = now[shown] - first
        known = total > 0
        done = np.where(known, np.clip(completed, 0.0, total), np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            percent, eta = 100.0 * done / total, np.where((done > 0) & (done < total), elapsed * (total - done) / done, np.nan)
        percent, eta = (np.where(np.isnan(x), None, x) for x in (percent, eta))
        own = {c: rows[c].to_numpy()[shown] for c in ("stage", "seq")}
        return pd.DataFrame({**own, "now": now[shown], "percent": percent, "elapsed": elapsed, "eta": eta}), first, last

    if not updates.isStreaming:
        stretches = _stretches(updates, interval)

        def fold_stretch(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("seq")
            return fold(rows, float(rows["_first"].iloc[0]), 0.0 if rows["_opens"].iloc[0] else float("-inf"))[0]

        return stretches.groupBy("_owner", "_k").applyInPandas(fold_stretch, out)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(batches))
        shown, first, last = fold(rows, first, last)
        state.update((first, last))
        yield shown

    from pyspark.sql.streaming.state import GroupStateTimeout

    return updates.groupBy("stage").applyInPandasWithState(step, out, "first double, last double", "append", GroupStateTimeout.NoTimeout)


def reassembled_lines(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of byte chunks (keys, seq, chunk), also where a chunk ends inside a character; an unfinished last line counts.

    A key may be of any size: what lies ahead of a chunk is told by counts of line feeds, which sorted partitions hand on, and
    the parts of a line meet by its number. Only a line is held whole. seq tells the chunks of a key apart; a null chunk is empty.
    """
    said = chunks.select(*keys, "seq", F.decode(F.coalesce("chunk", F.lit(b"")), "ISO-8859-1").alias("_t"))  # a character for each byte
    feeds = said.select(*keys, "seq", (F.length("_t") - F.length(F.replace("_t", F.lit("\n"), F.lit("")))).cast("long").alias("_n"))
    ahead = running_before(feeds, keys, "seq", "_n", "_ahead").drop("_n")
    met = said.alias("c").join(ahead.alias("a"), [F.col(f"c.{k}").eqNullSafe(F.col(f"a.{k}")) for k in [*keys, "seq"]]).select("c.*", "a._ahead")
    parts = met.withColumn("_parts", F.split("_t", "\n"))
    parts = parts.select(*keys, "seq", "_ahead", F.size("_parts").alias("_size"), F.posexplode("_parts").alias("_k", "_part"))
    pieces = F.array_sort(F.collect_list(F.struct("seq", "_k", "_part")))
    lines = parts.groupBy(*keys, (F.col("_ahead") + F.col("_k")).alias("line_no")).agg(
        F.array_join(F.transform(pieces, lambda x: x["_part"]), "").alias("_line"), F.max(F.col("_k") < F.col("_size") - 1).alias("_fed")
    )
    line = F.encode(F.regexp_replace("_line", "\r$", ""), "ISO-8859-1").cast("string")
    return lines.where("_fed OR _line <> ''").select(*keys, F.col("line_no").cast("int").alias("line_no"), line.alias("line"))


def latest(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; an update-mode aggregate on streams."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def output_tail(lines: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The last lines of each run that are no progress."""
    from pyspark.sql import Window

    rest = lines.where(parsed_progress(F.col("line")).isNull())
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("line_no").desc()))
    return rest.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")
