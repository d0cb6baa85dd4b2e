"""Exact deduplication by content sort.

The order is that of the normalised texts, then of the identifiers. Splitters sampled from the rows cut
that order into ranges; a range is dealt to a partition as it stands and sorted there, so equal texts
are adjacent, and each row is compared in full with the row before it. A run of equal neighbours has
its smallest identifier first. Identifiers are part of the order, so a frequent text lies across as many
ranges as it fills: the last text of a range is compared with the first of the next, and runs that go on
are joined along the ranges. Of a range that is one row for the driver and at most two of the broadcast.
No hash decides anything; the digest is a column of the result. DataFrame functions only.

Defined results: null text counts as empty; a null identifier sorts after all others; of rows that
repeat one identifier exactly one is kept; an empty table gives an empty result; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import json
from collections import Counter
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lintel.llm.common import whole_row, written

#: Sampled rows of a range, and the characters that are kept of a sampled text if no other begins so.
SAMPLED = 16
HEAD_CHARS = 128
#: The separators that count as one space when texts are compared.
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"
#: What orders rows of equal texts.
TIE = ("none", "id", "number")


def normalised(text_col: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col) if isinstance(text_col, str) else text_col, F.lit("")), SEPARATOR_RUN, " ")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed_rows(docs: DataFrame, id_col: str, text_col: str, *carried: Column) -> DataFrame:
    """norm (the normalised text), what orders equal ones, and the carried columns."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"), *carried)
    return rows.withColumns({"none": F.col("id").isNull(), "number": F.monotonically_increasing_id()})


def sampled_splitters(rows: DataFrame, ranges: int) -> list[dict]:
    """Where ranges begin, in order. A text whose head no other sampled text has is cut to it, which splits as well; others are
    whole, since rows that begin alike, or are one text, may have to be split."""
    if ranges < 2:
        return []
    total = rows.select("number").count()
    share = min(1.0, SAMPLED * ranges / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("number"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = drawn.select(F.substring("norm", 1, HEAD_CHARS).alias("head"), F.xxhash64("norm").alias("hash"), F.length("norm").alias("chars"), *TIE).collect()
    sample.sort(key=lambda r: (r["head"].encode(), r["hash"], r["none"], (r["id"] is not None, r["id"] if r["id"] is not None else 0), r["number"]))
    chosen = [sample[k * len(sample) // ranges] for k in range(1, ranges)] if sample else []
    often = Counter(r["head"] for r in sample)
    cut = [r["number"] for r in chosen if r["chars"] > HEAD_CHARS and often[r["head"]] > 1]
    whole = dict(rows.where(F.col("number").isin(cut)).select("number", "norm").collect()) if cut else {}
    out = [{"norm": whole.get(r["number"], r["head"]), **{c: r[c] for c in TIE}} for r in chosen]
    return sorted(out, key=lambda s: (s["norm"].encode(), s["none"], (s["id"] is not None, s["id"] if s["id"] is not None else 0), s["number"]))


def range_of(splitters: list[dict], schema: StructType) -> Column:
    """The number of splitters that a row's key reaches: counted among every so manieth, then among those that follow."""
    if not splitters:
        return F.lit(0)
    kind = "struct<" + ", ".join(f"{c}:{schema[c].dataType.simpleString()}" for c in ("norm", *TIE)) + ">"
    step = isqrt(len(splitters))
    groups = [splitters[k : k + step] for k in range(0, len(splitters), step)]
    literal = lambda value, of: F.from_json(F.lit(json.dumps(value)), of)
    tie = F.struct(*TIE)

    def reached(among: Column) -> Column:
        return F.size(F.filter(among, lambda s: (s["norm"] < F.col("norm")) | ((s["norm"] == F.col("norm")) & (F.struct(*[s[c].alias(c) for c in TIE]) <= tie))))

    group = reached(literal([g[0] for g in groups], f"array<{kind}>"))
    within = reached(F.element_at(literal(groups, f"array<array<{kind}>>"), group))
    return F.when(group == 0, 0).otherwise((group - 1) * step + within)


def content_runs(rows: DataFrame, ranges: int, *carried: str) -> DataFrame:
    """Rows in content order, cut: range, run (numbered within the range), starts (the run), keep_id and run_size of the run,
    opens and closes (the range); the text where a range opens or closes, and the carried columns where a run starts."""
    in_order = Window.partitionBy("range").orderBy("norm", *TIE)
    before, after = F.lag("norm").over(in_order), F.lead("number").over(in_order)
    place = F.row_number().over(in_order)
    dealt = rows.withColumn("range", range_of(sampled_splitters(rows, ranges), rows.schema)).repartitionById(ranges, F.col("range").cast("int"))
    marked = dealt.withColumns({"place": place, "starts": before.isNull() | (before != F.col("norm")), "closes": after.isNull()})
    marked = marked.withColumn("run", F.sum(F.col("starts").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    opens = F.col("place") == 1
    narrow = marked.select(
        "range", "run", "place", "id", "starts", "closes", opens.alias("opens"), digest(F.col("norm")).alias("sha"),
        F.when(opens | F.col("closes"), F.col("norm")).alias("edge"), *[F.when(F.col("starts"), F.col(c)).alias(c) for c in carried],
    )
    of_run = Window.partitionBy("range", "run")
    first = F.min(F.struct("place", "id")).over(of_run).getField("id")
    return written(narrow.withColumns({"keep_id": first, "run_size": F.count(F.lit(1)).over(of_run)}).drop("place"))


def joined_runs(runs: DataFrame) -> DataFrame:
    """range, run, keep_id, group_size and owns (is the first) of the runs that lie across ranges: at most two of a range."""
    lasts = {r["range"]: r for r in runs.where("closes").select("range", "run", "run_size", "keep_id").collect()}
    there = sorted(lasts)
    following = dict(zip(there, there[1:], strict=False))
    pairs = runs.sparkSession.createDataFrame(list(following.items()), "range int, next int")
    closing = runs.where("closes").select("range", F.col("edge").alias("last_text")).join(pairs, "range")
    opening = runs.where("opens").select(F.col("range").alias("next"), F.col("edge").alias("first_text"), "run_size")
    goes_on = {r["range"]: r["run_size"] for r in closing.join(opening, "next").where("last_text = first_text").select("range", "run_size").collect()}

    owner: dict[int, tuple[int, int]] = {}
    found: dict[tuple[int, int], list] = {}
    for now in there:
        if now in goes_on:
            last = lasts[now]
            root = owner[now] if last["run"] == 1 and now in owner else (now, last["run"])
            group = found.setdefault(root, [last["keep_id"], last["run_size"]])
            group[1] += goes_on[now]
            owner[following[now]] = root
    out = [(*root, *group, True) for root, group in found.items()] + [(now, 1, *found[root], False) for now, root in owner.items()]
    kind = runs.schema["id"].dataType.simpleString()
    return runs.sparkSession.createDataFrame(out, f"range int, run long, group_id {kind}, group_size long, owns boolean")


def _verdicts(runs: DataFrame) -> DataFrame:
    """The runs' rows with keep_id, group_size and kept."""
    met = runs.join(F.broadcast(joined_runs(runs)), ["range", "run"], "left")
    across = F.col("owns").isNotNull()
    return met.withColumns(
        {
            "keep_id": F.when(across, F.col("group_id")).otherwise(F.col("keep_id")),
            "group_size": F.when(across, F.col("group_size")).otherwise(F.col("run_size")),
            "kept": F.col("starts") & F.coalesce("owns", F.lit(True)),
        }
    )


def _ranges(docs: DataFrame, ranges: int | None) -> int:
    return ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Ranges: as many as shuffles have partitions."""
    found = _verdicts(content_runs(keyed_rows(docs, id_col, text_col), _ranges(docs, ranges)))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """The rows that stay, one of each text, with all their columns."""
    rows = keyed_rows(docs, id_col, text_col, whole_row(docs))
    return _verdicts(content_runs(rows, _ranges(docs, ranges), "row")).where("kept").select("row.*")
