"""Candidates of reviews in files without blocks, and album entries from candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import lexicon, text
from lintel.operators import documents
from lintel.operators.people import performer_parts
from lintel.operators.runs import first_of_each
from lintel.operators.shared import written
from lintel.sources.mail import mail_html

CANDIDATE = (
    "file string, line_no int, title_hint string, performer_hint string, label_hint string, title_line string, performer_line string,"
    " label_line string, raw_text string, subsection string"
)
UNDERLINE, HELD = r"^[-=]{3,}$", r"\(([^)]+)\)$"
AHEAD = 6


def _distinct(found: DataFrame, key: str) -> DataFrame:
    """Without titles that are none; of candidates that agree after normalising the first."""
    title = F.trim("title_hint")
    good = found.where((F.length(title) >= 5) & ~title.rlike(r"^\d{4}$") & ~F.contains("title_hint", F.lit("Related Articles")))
    marks = {f"_{c}": text.normalize(F.col(c)) for c in ("title_hint", "performer_hint", "label_hint")}
    return first_of_each(good.withColumns(marks), [key, *marks], "line_no").drop(*marks)


def plain_candidates(lines: DataFrame, key: str = "file") -> DataFrame:
    """Candidates (CANDIDATE) of lines (key, line_no, line) whose titles stand in bold.

    A title is underlined, or no line after it within three ends in parentheses. Performer and label are
    looked for in the six lines after it, up to a rule, a bold year or the next underlined line: a bold line
    that ends in parentheses, or 'Label:' after bold performers.
    """
    line = F.trim("line")
    by_line = Window.partitionBy(key).orderBy("line_no")
    shown = lines.select(key, "line_no", line.alias("line"), F.coalesce(F.lead(line).over(by_line).rlike(UNDERLINE), F.lit(False)).alias("underlined"))
    ahead = F.collect_list(F.struct("line", "underlined")).over(by_line.rowsBetween(1, AHEAD + 1))
    title = text.squeeze(F.replace("line", F.lit("**"), F.lit(" ")))
    bold = F.startswith("line", F.lit("**")) & ~F.startswith("line", F.lit("**Source:**")) & ~F.startswith("line", F.lit("**![")) & ~F.contains("line", F.lit("![Image"))
    told = shown.withColumns({"ahead": ahead, "title": title}).where(bold & (F.length("title") >= 5) & ~F.col("title").rlike(r"^\d{4}$"))
    beside = F.exists(F.slice("ahead", 1, 3), lambda a: (a["line"] != "") & a["line"].rlike(HELD))
    told = told.where(F.col("underlined") | (~F.col("line").rlike(HELD) & ~beside))
    told = written(told.withColumn("ahead", F.when(F.col("underlined"), F.slice("ahead", 2, AHEAD)).otherwise(F.slice("ahead", 1, AHEAD))))  # read twice

    rows = told.select(key, "line_no", F.posexplode_outer("ahead").alias("at", "a")).select(key, "line_no", "at", F.col("a.line").alias("next"), F.col("a.underlined").alias("heads")).where("next <> ''")
    stop = F.startswith("next", F.lit("---")) | F.startswith("next", F.lit("**20")) | F.col("heads")
    strong = F.startswith("next", F.lit("**"))
    clean = F.replace(F.replace("next", F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    kinds = rows.withColumns(
        {
            "clean": clean,
            "stop": stop,
            "tells": ~stop & ((strong & clean.rlike(HELD)) | (~strong & F.startswith(F.lower("next"), F.lit("label:")))),
            "names": ~stop & strong & ~clean.rlike(HELD),
        }
    )
    own = Window.partitionBy(key, "line_no")
    kinds = kinds.withColumn("end", F.min(F.when(F.col("stop") | F.col("tells"), F.col("at"))).over(own))
    found = kinds.groupBy(key, "line_no").agg(
        F.max(F.when((F.col("at") == F.col("end")) & F.col("tells"), F.struct("next", "clean"))).alias("told"),
        F.max(F.when(F.col("names") & (F.col("end").isNull() | (F.col("at") < F.col("end"))), F.struct("at", "next", "clean"))).alias("last"),
    )
    held = F.regexp_extract("told.clean", HELD, 1)
    by_bold = F.startswith("told.next", F.lit("**"))
    before = F.trim(F.regexp_replace("told.clean", HELD, ""))
    last_clean, last_line = F.coalesce("last.clean", F.lit("")), F.coalesce("last.next", F.lit(""))
    label = F.when(by_bold, held).otherwise(F.trim(F.regexp_replace("told.next", "^[^:]*:", "")))
    performer = F.when(by_bold & (before != ""), before).otherwise(last_clean)
    performer_line = F.when(by_bold & (before != ""), F.col("told.next")).when(by_bold, last_clean).otherwise(last_line)
    out = told.join(found.where("told IS NOT NULL"), [key, "line_no"])
    named = out.select(
        key,
        (F.col("line_no") + F.col("underlined").cast("int")).cast("int").alias("line_no"),
        F.col("title").alias("title_hint"),
        performer.alias("performer_hint"),
        label.alias("label_hint"),
        F.col("line").alias("title_line"),
        performer_line.alias("performer_line"),
        F.col("told.next").alias("label_line"),
        F.substring("line", 1, 200).alias("raw_text"),
    ).where("performer_hint <> '' OR label_hint <> ''")
    said = F.filter(F.array("title_line", "performer_line", "label_line"), lambda s: s != "")
    return _distinct(named.withColumn("subsection", F.array_join(said, "\n")), key)


def markdown_candidates(blocks: DataFrame, lines: DataFrame, key: str = "file") -> DataFrame:
    """The candidates of blocks (as ``review_blocks`` gives them), and plain ones of files that have none."""
    hints = {"title_hint": F.col("title"), "performer_hint": F.col("performer"), "label_hint": F.col("label"), "title_line": F.col("title"), "performer_line": F.col("performer")}
    label_line = F.when(F.col("label") != "", F.concat(F.lit("("), "label", F.lit(")"))).otherwise("")
    rest = {"label_line": label_line, "raw_text": F.substring("title", 1, 200), "subsection": F.col("title"), "line_no": F.col("line_no").cast("int")}
    columns = [key, *[c.split()[0] for c in CANDIDATE.split(", ")[1:]]]
    own = written(blocks.withColumns({**hints, **rest}).select(*columns))  # the files without blocks ask for it again
    others = plain_candidates(lines.join(own.select(key).distinct(), key, "left_anti"), key)
    return own.unionByName(others.select(*columns))


def hinted_candidates(hints: DataFrame, key: str = "file") -> DataFrame:
    """Candidates (CANDIDATE) of the headings of a page with their performers and labels (key, group, title, performer, label)."""
    said = lambda c: F.coalesce(c, F.lit(""))
    found = hints.select(
        key, F.col("group").cast("int").alias("line_no"), F.col("title").alias("title_hint"), said("performer").alias("performer_hint"), said("label").alias("label_hint"), F.col("title").alias("title_line"),
        said("performer").alias("performer_line"), F.when(said("label") != "", F.concat(F.lit("("), "label", F.lit(")"))).otherwise("").alias("label_line"), F.col("title").alias("raw_text"), F.lit("").alias("subsection"),
    )
    return _distinct(found, key)


def mail_candidates(mails: DataFrame, key: str = "file", content: str = "content") -> DataFrame:
    """Candidates (CANDIDATE) of MIME archives of pages: their first HTML part, its headings, and what stands below them."""
    pages = mail_html(mails, key, content)
    return hinted_candidates(documents.heading_hints(documents.html_elements(pages, key, "html"), key), key)


def file_candidates(files: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Candidates of files (file, content) by their endings: archives of pages, or Markdown; another ending raises.

    blocks: review blocks of Markdown files, where they are known.
    """
    kinds = files.withColumn("_kind", file_kind(F.col("file")))
    lines = kinds.where("_kind = 'markdown'").select("file", F.posexplode(F.split(F.regexp_replace(F.col("content").cast("string"), "\r\n", "\n"), "\n")).alias("n", "line"))
    lines = lines.select("file", (F.col("n") + 1).alias("line_no"), "line")
    blocks = blocks if blocks is not None else documents.review_blocks(lines, "file")
    return markdown_candidates(blocks, lines).unionByName(mail_candidates(kinds.where("_kind = 'mail'")))


def file_kind(file: Column) -> Column:
    """'mail' or 'markdown' by a file's ending; others raise."""
    ending = F.lower(F.regexp_extract(file, r"\.([^./]+)$", 1))
    bad = F.raise_error(F.concat(F.lit("Unsupported file extension: "), ending)).cast("string")
    return F.when(ending.isin("mhtml", "mht"), "mail").when(ending.isin("md", "markdown"), "markdown").otherwise(bad)


def plain_performers(hint: Column) -> Column:
    """performers, ensembles, conductor and instruments of a line without marks.

    The last part after a slash conducts if it names no ensemble. Instruments end a performer's name;
    without any, names are apart by semicolons and commas, and short names after an ensemble belong to it.
    """
    none = F.array().cast("array<string>")
    raw = F.coalesce(hint, F.lit(""))
    instruments = text.instruments_in(raw)
    parts = F.filter(F.transform(F.split(raw, "/"), lambda p: F.trim(p)), lambda p: p != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    conducts = (F.size(parts) > 1) & ~text.names_ensemble(last)
    left = F.when(conducts, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " / ")).otherwise(raw)

    tokens = F.filter(F.transform(F.split(left, r"\s+"), lambda t: F.regexp_replace(t, "^[,;]+|[,;]+$", "")), lambda t: t != "")
    marked = F.transform(tokens, lambda t: F.when(F.lower(t).isin(*lexicon.INSTRUMENTS), F.lit("\x01")).otherwise(t))
    groups = F.transform(marked, lambda t: (t != "\x01") & text.names_ensemble(t))
    at = F.array_position(groups, F.lit(True)).cast("int")
    names = F.when(at > 0, F.slice(marked, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(marked)
    said = F.transform(F.split(F.array_join(names, " "), "\x01"), lambda g: F.trim(g))
    current = F.element_at(said, -1)
    group = F.trim(F.array_join(F.concat(F.array(current), F.slice(tokens, F.greatest(at, F.lit(1)), F.size(tokens))), " "))
    with_tools = F.struct(
        F.filter(F.when(at > 0, F.slice(said, F.lit(1), F.greatest(F.size(said) - 1, F.lit(0)))).otherwise(said), lambda g: g != "").alias("performers"),
        F.when(at > 0, F.array(group)).otherwise(none).alias("ensembles"),
    )

    segments = F.filter(F.flatten(F.transform(F.split(left, ";"), lambda c: F.transform(F.split(c, ","), lambda p: F.trim(p)))), lambda p: (p != "") & ~F.lower(p).isin(*lexicon.SKIPPED_SEGMENTS))

    def fold(state: Column, segment: Column) -> Column:
        held, own = state["ensembles"], state["performers"]
        more = F.concat(F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))), F.array(F.concat_ws(", ", F.try_element_at(held, F.lit(-1)), segment)))
        is_group, joins = text.names_ensemble(segment), (F.size(held) > 0) & (F.size(F.split(segment, r"\s+")) <= 2)
        return F.struct(
            F.when(is_group | joins, own).otherwise(F.concat(own, F.array(segment))).alias("performers"),
            F.when(is_group, F.concat(held, F.array(segment))).when(joins, more).otherwise(held).alias("ensembles"),
        )

    without = F.aggregate(segments, F.struct(none.alias("performers"), none.alias("ensembles")), fold)
    people = F.when(F.size(instruments) > 0, with_tools).otherwise(without)
    return F.struct(people["performers"].alias("performers"), people["ensembles"].alias("ensembles"), F.when(conducts, last).otherwise("").alias("conductor"), instruments.alias("instruments"))


def album_entries(candidates: DataFrame, key: str = "candidate") -> DataFrame:
    """key, source and album: an album entry from each candidate (CANDIDATE and a key)."""

    def of(column: str, *others: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (column, *others)], F.lit(""))

    held_label = F.when(of("label_hint") != "", F.concat(F.lit("("), "label_hint", F.lit(")"))).otherwise("")
    rows = candidates.select(
        "*",
        of("title_line", "title_hint").alias("_title"),
        of("performer_line", "performer_hint").alias("_performer"),
        F.coalesce(F.nullif("label_line", F.lit("")), held_label).alias("_label"),
        of("subsection", "raw_text", "title_hint").alias("_said"),
    )
    rows = written(rows)  # their performers are told apart and join them again
    parts = performer_parts(rows.select(key, F.col("_performer").alias("performer_line"), F.col("_label").alias("label_line")), key)
    both = rows.join(parts.withColumnsRenamed({c: f"_{c}" for c in ("performers", "ensembles", "conductor", "instruments", "label")}).withColumnRenamed("_label", "_own_label"), key)
    nobody = (F.size("_performers") == 0) & (F.size("_ensembles") == 0) & (F.col("_conductor") == "")
    both = both.withColumn("_plain", plain_performers(F.col("performer_hint")))
    title = text.heading_title(F.col("_title"), F.coalesce("title_hint", F.lit("")))
    full = F.coalesce(F.nullif(text.plain_inline(F.regexp_replace("_title", r"^#{1,6}\s*", "")), F.lit("")), F.col("title_hint"))
    told = both.withColumns({"_short": title, "_full": full, "_people": text.heading_people(F.col("_title"))})
    slugs = text.slug_phrases(text.review_slug(F.col("_said")), F.concat(F.array("title_hint", "_short"), "_people"))
    works = text.merge_unique(F.concat(F.array("_short", "title_hint"), slugs, text.italic_phrases(F.col("_said"))))
    context = F.create_map(F.lit("title_line"), F.col("_title"), F.lit("performer_line"), F.col("_performer"), F.lit("label_line"), F.col("_label"))
    source = F.struct("file", F.coalesce("line_no", F.lit(0)).alias("line"), of("raw_text", "_said", "title_hint").alias("raw"), F.col("_said").alias("subsection"), context.alias("context"))
    album = F.struct(
        F.col("_short").alias("title"),
        text.unlike(F.col("_people"), F.col("_short"), F.col("_full")).alias("composers"),
        *[F.when(nobody, F.col(f"_plain.{c}")).otherwise(F.col(f"_{c}")).alias(c) for c in ("performers", "ensembles", "conductor")],
        F.coalesce(F.nullif("_own_label", F.lit("")), F.col("label_hint")).alias("label"),
        F.lit("").alias("year"),
        F.when((F.size("works") == 0) & (F.col("_short") != ""), F.array("_short")).otherwise(F.col("works")).alias("works"),
        F.when(nobody & (F.size("_instruments") == 0), F.col("_plain.instruments")).otherwise(F.col("_instruments")).alias("instruments"),
    )
    return told.withColumn("works", works).select(key, source.alias("source"), album.alias("album"))
