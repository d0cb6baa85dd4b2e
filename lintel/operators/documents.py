"""Page ranges, sections and blocks of Markdown, links in blocks, catalogue resources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import text
from lintel.operators.runs import consecutive_ranges, first_of_each, with_batches

ERROR = "Invalid page range"
SEPARATOR = r"^\*\s+\*\s+\*$"


def page_lists(specs: DataFrame, spec: str = "spec", pages: str = "page_count", one_based: bool = True) -> DataFrame:
    """Adds pages (sorted, distinct) for '1,3,5-N', and problem (null if the specification is good)."""
    count = F.col(pages)
    parts = F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda p: F.trim(p))

    def number(token: Column) -> Column:
        return F.when(F.lower(token) == "n", count).otherwise(token.try_cast("int"))

    def ends(part: Column) -> Column:
        lo = number(F.trim(F.element_at(F.split(part, "-"), 1)))
        hi = number(F.trim(F.element_at(F.split(part, "-"), -1)))
        return F.struct(part.alias("part"), F.size(F.split(part, "-")).alias("n"), lo.alias("lo"), hi.alias("hi"))

    found = specs.withColumn("_e", F.transform(parts, ends))
    hyphens = F.filter("_e", lambda e: (e["n"] > 2) | ((e["n"] == 2) & e["part"].rlike(r"^\s*-|-\s*$")))
    problem = (
        F.when(count < 1, "no pages")
        .when(F.exists("_e", lambda e: e["part"] == ""), "empty item")
        .when(F.size(hyphens) > 0, "malformed range")
        .when(F.exists("_e", lambda e: e["lo"].isNull() | e["hi"].isNull()), "not a page number")
        .when(F.exists("_e", lambda e: (e["lo"] < 1) | (e["hi"] < 1)), "pages start at 1")
        .when(F.exists("_e", lambda e: (e["lo"] > count) | (e["hi"] > count)), "outside the document")
        .when(F.exists("_e", lambda e: e["hi"] < e["lo"]), "end before start")
    )
    shift = 0 if one_based else 1
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform("_e", lambda e: F.sequence(e["lo"] - shift, e["hi"] - shift)))))
    return found.withColumn("problem", problem).withColumn("pages", F.when(F.col("problem").isNull(), listed)).drop("_e")


def checked_page_lists(specs: DataFrame, **options) -> DataFrame:
    """As page_lists, but a bad specification raises."""
    bad = F.raise_error(F.concat_ws(": ", F.lit(ERROR), "problem")).cast("array<int>")
    return page_lists(specs, **options).withColumn("pages", F.when(F.col("problem").isNull(), F.col("pages")).otherwise(bad)).drop("problem")


def range_texts(pages: DataFrame, keys: list[str], page: str) -> DataFrame:
    """'1-2,4' of the distinct pages of each key."""
    runs = consecutive_ranges(pages, keys, page)
    shown = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", F.col("lo"), F.col("hi")))
    parts = F.array_sort(F.collect_list(F.struct("lo", shown.alias("s"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["s"]), ",").alias("ranges"))


def missing_chunks(items: DataFrame, keys: list[str], order: str, size: int, done: DataFrame) -> DataFrame:
    """Batches of items for which done (keys, batch, length) has no part of any length."""
    wanted = with_batches(items, keys, size, order).groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("items"))
    return wanted.join(done.where("length > 0"), [*keys, "batch"], "left_anti")


def chapter_marks(tracks: DataFrame, keys: list[str], order: str, seconds: str) -> DataFrame:
    """Start and end of each chapter in whole milliseconds: running totals, rounded to even."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = tracks.withColumn("end_ms", F.bround(F.sum(F.col(seconds) * 1000).over(upto), 0).cast("long"))
    return ends.withColumn("start_ms", F.coalesce(F.lag("end_ms").over(Window.partitionBy(*keys).orderBy(order)), F.lit(0)).cast("long"))


def cover_of_each(files: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The cover picture of each key: named so exactly, named so in part, or the first by name."""
    stem, wanted = F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), ["cover", "front", "folder"]
    rank = F.lit(len(wanted) * 2)
    for k, word in reversed(list(enumerate(wanted))):
        rank = F.when(F.contains(stem, F.lit(word)), len(wanted) + k).otherwise(rank)
    for k, word in reversed(list(enumerate(wanted))):
        rank = F.when(stem == word, k).otherwise(rank)
    pictures = files.where(F.lower(name).rlike(r"\.(jpg|jpeg|png)$") & ~F.startswith(name, F.lit(".")))
    last = F.when(F.col("_rank") == len(wanted) * 2, F.lower(name)).otherwise("")
    return first_of_each(pictures.withColumn("_rank", rank), keys, "_rank", last, name).drop("_rank")


def fenced_sections(lines: DataFrame, key: str, marker: str = "##") -> DataFrame:
    """Adds section (from 0: before the first heading) and heading; headings in fenced code do not count.

    A fence closes with its own character at its own length or more, so whether a line is inside is a
    fold over the lines of a document: its lines come together in one row, and a batch holds many documents.
    """

    def fold(lines: list[str]) -> tuple[list[int], list[str]]:
        section, heading, fence = 0, "", ""
        sections, headings = [], []
        for line in lines:
            shown = line[min(3, len(line) - len(line.lstrip(" \t"))) :]
            mark = shown[: len(shown) - len(shown.lstrip(shown[:1]))] if shown[:1] in ("`", "~") else ""
            if not fence and (shown == marker or shown.startswith((f"{marker} ", f"{marker}\t"))):
                section, heading = section + 1, shown[len(marker) :].strip().rstrip("#").strip()
            if len(mark) >= 3:
                if not fence:
                    fence = mark
                elif mark[0] == fence[0] and len(mark) >= len(fence):
                    fence = ""
            sections.append(section)
            headings.append(heading)
        return sections, headings

    @F.pandas_udf("section array<long>, heading array<string>")
    def folded(documents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fold(lines) for lines in documents], columns=["section", "heading"])

    told = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").cast("long").alias("line_no"), "line"))).alias("_l"))
    told = told.withColumn("_f", folded(F.col("_l.line")))
    zipped = F.arrays_zip(F.col("_l.line_no"), F.col("_l.line"), F.col("_f.section"), F.col("_f.heading"))
    return told.select(key, F.explode(zipped).alias("_z")).select(key, *[F.col("_z")[c].alias(c) for c in ("line_no", "line", "section", "heading")])


def section_files(sections: DataFrame, key: str, preamble: str = "Preamble") -> DataFrame:
    """file_name and content of each section; names that collide are numbered from 2."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    whole = sections.groupBy(key, "section").agg(F.first("heading").alias("h"), F.concat(F.array_join(F.transform(parts, lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))
    named = whole.withColumn("_name", F.when(F.col("section") == 0, preamble).otherwise(text.file_name(F.col("h"))))
    nth = F.row_number().over(Window.partitionBy(key, "_name").orderBy("section"))
    return named.withColumn("_n", nth).select(key, "section", F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.concat_ws(" ", "_name", F.col("_n").cast("string"))).alias("file_name"), "content")


def with_blocks(lines: DataFrame, key: str) -> DataFrame:
    """Adds block: separators end a block and belong to none (null)."""
    is_mark = F.trim("line").rlike(SEPARATOR)
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_b", F.sum(is_mark.cast("int")).over(upto)).withColumn("block", F.when(~is_mark, F.col("_b"))).drop("_b")


def review_blocks(lines: DataFrame, key: str) -> DataFrame:
    """Of each block with a review line: title (last heading at or before it) with its line_no, performer and label.

    Performer and label stand between the heading and the next heading or review line. The label is what
    trailing parentheses of the performer line hold or what follows 'Label:'. Blocks with neither go, as do
    titles that are none; of blocks that agree after normalising the first stays. Related items end a file.
    """
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ended = F.max(F.trim("line").rlike("^## Related (Reviews|News)").cast("int")).over(upto)
    blocks = with_blocks(lines.withColumn("_ended", ended), key).where("block IS NOT NULL AND _ended = 0")
    line = F.trim("line")
    shown = blocks.select(
        key,
        "block",
        "line_no",
        line.alias("line"),
        F.startswith(line, F.lit("##")).alias("heading"),
        (F.contains(F.lower(line), F.lit("/review/")) & F.contains(line, F.lit("]("))).alias("review"),
        text.squeeze(F.replace(text.bold_headings(line), F.lit("__"), F.lit(""))).alias("cleaned"),
    )
    own = Window.partitionBy(key, "block")
    marked = shown.withColumn("_review", F.min(F.when(F.col("review"), F.col("line_no"))).over(own)).where("_review IS NOT NULL")
    names_work = F.col("heading") & (F.col("line_no") <= F.col("_review")) & ~F.contains("line", F.lit("![](")) & ~F.col("line").rlike("Related (Reviews|News)") & (F.col("cleaned") != "")
    titled = marked.withColumn("t", F.max(F.when(names_work, F.struct("line_no", "cleaned"))).over(own)).where("t IS NOT NULL")
    same = F.col("heading") & (F.col("cleaned") == F.col("t.cleaned"))
    begun = titled.withColumn("_same", same).withColumn("_from", F.min(F.when(F.col("_same"), F.col("line_no"))).over(own))
    stops = (F.col("line_no") > F.col("_from")) & ~F.col("_same") & (F.col("heading") | F.col("review"))
    told = begun.withColumn("_to", F.min(F.when(stops, F.col("line_no"))).over(own))
    detail = (F.col("line_no") > F.col("_from")) & (F.col("_to").isNull() | (F.col("line_no") < F.col("_to"))) & ~F.col("heading") & (F.col("line") != "")
    labelled, value = F.startswith(F.lower("line"), F.lit("label:")), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    out = told.groupBy(key, "block").agg(
        F.max("t").alias("t"),
        F.min(F.when(detail & ~labelled, F.struct("line_no", F.trim(F.regexp_replace("line", "[*_]", "")).alias("line")))).alias("p"),
        F.min(F.when(detail & labelled & (value != ""), F.struct("line_no", value.alias("label")))).alias("l"),
    )
    held, title = r"\(([^)]+)\)\s*$", F.col("t.cleaned")
    found = out.select(
        key,
        "block",
        F.col("t.line_no").alias("line_no"),
        title.alias("title"),
        F.coalesce(F.trim(F.regexp_replace("p.line", held, "")), F.lit("")).alias("performer"),
        F.coalesce(F.nullif(F.trim(F.regexp_extract("p.line", held, 1)), F.lit("")), F.col("l.label"), F.lit("")).alias("label"),
    ).where((F.col("performer") != "") | (F.col("label") != ""))
    found = found.where((F.length("title") >= 5) & ~F.contains("title", F.lit("Related Articles")))
    marks = {f"_{c}": text.normalize(F.col(c)) for c in ("title", "performer", "label")}
    return first_of_each(found.withColumns(marks), [key, *marks], "line_no").drop(*marks)


def with_links(lines: DataFrame, updates: DataFrame, key: str, markers: list[str]) -> DataFrame:
    """Lines with one link in each block that an update (key, source_line, link) points into; numbered anew.

    The first line of the rest of the block that holds a marker is replaced; without one the link goes
    after the last line that is not blank, with blank lines around it. Of the updates of a block that
    with the smallest source line counts.
    """
    is_mark = F.trim("line").rlike(SEPARATOR)
    after = Window.partitionBy(key).orderBy("line_no").rowsBetween(0, Window.unboundedFollowing)
    ends = lines.withColumn("block_end", F.min(F.when(is_mark, F.col("line_no"))).over(after))
    begun = updates.join(ends.select(key, F.col("line_no").alias("source_line"), "block_end"), [key, "source_line"])
    first = first_of_each(begun, [key, "block_end"], "source_line")
    u = first.select(F.col(key).alias("_k"), "source_line", F.col("block_end").alias("_end"), "link")
    inside = (F.col(key) == F.col("_k")) & F.col("block_end").eqNullSafe(F.col("_end")) & (F.col("line_no") >= F.col("source_line")) & ~is_mark
    held = F.exists(text.texts(markers), lambda m: F.contains(F.col("line"), m))
    target = Window.partitionBy(key, "_end")
    met = ends.join(u, inside, "left").withColumn("_old", F.when(F.col("link").isNotNull(), F.min(F.when(held & F.col("link").isNotNull(), F.col("line_no"))).over(target)))
    met = met.withColumn("_last", F.when(F.col("link").isNotNull(), F.max(F.when(F.trim("line") != "", F.col("line_no"))).over(target)))
    replaced = F.when(F.col("line_no") == F.col("_old"), F.array(F.col("link")))
    added = F.when(F.col("_old").isNull() & (F.col("line_no") == F.col("_last")), F.array(F.col("line"), F.lit(""), F.col("link"), F.lit("")))
    out = met.select(key, "line_no", F.posexplode(F.coalesce(replaced, added, F.array("line"))).alias("_at", "line"))
    return out.select(key, F.row_number().over(Window.partitionBy(key).orderBy("line_no", "_at")).alias("line_no"), "line")


def included_lookup(documents: DataFrame, key: str, json: str, relation: str, kind: str) -> DataFrame:
    """The included objects of a JSON document that a relation names, in its order: key, pos, id and attributes (variant)."""
    parsed = documents.select(key, F.try_parse_json(json).alias("_v"))
    named = parsed.select(key, F.posexplode(F.try_variant_get("_v", f"$.data.relationships.{relation}.data", "array<variant>")).alias("pos", "_r"))
    named = named.select(key, "pos", F.try_variant_get("_r", "$.id", "string").alias("id"), F.try_variant_get("_r", "$.type", "string").alias("type")).where(F.col("type") == kind)
    included = parsed.select(key, F.explode(F.try_variant_get("_v", "$.included", "array<variant>")).alias("_i"))
    included = included.select(key, F.try_variant_get("_i", "$.id", "string").alias("id"), F.try_variant_get("_i", "$.type", "string").alias("type"), F.try_variant_get("_i", "$.attributes", "variant").alias("attributes"))
    return named.join(included, [key, "id", "type"]).select(key, "pos", "id", "attributes")


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, row_no, col_no and text of the cells of all tables; header rows are rows."""
    from html.parser import HTMLParser

    class Cells(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.rows: list[tuple[int, int, int, str]] = []
            self.table, self.row, self.col, self.open = -1, -1, -1, False
            self.said: list[str] = []

        def close_cell(self) -> None:
            if self.open:
                self.rows.append((self.table, self.row, self.col, " ".join(" ".join(self.said).split())))
            self.open = False

        def handle_starttag(self, tag: str, attrs) -> None:
            if tag == "table":
                self.close_cell()
                self.table, self.row = self.table + 1, -1
            elif tag == "tr":
                self.close_cell()
                self.row, self.col = self.row + 1, -1
            elif tag in ("td", "th"):
                self.close_cell()
                self.col, self.open, self.said = self.col + 1, True, []

        def handle_endtag(self, tag: str) -> None:
            if tag in ("td", "th", "tr", "table"):
                self.close_cell()

        def handle_data(self, data: str) -> None:
            if self.open:
                self.said.append(data)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, page in zip(batch[key], batch["_html"], strict=True):
                parser = Cells()
                parser.feed(page or "")
                parser.close()
                parser.close_cell()
                out += [(k, *cell) for cell in parser.rows]
            yield pd.DataFrame(out, columns=[key, "table_no", "row_no", "col_no", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(html).alias("_html")).mapInPandas(read, f"{key} {kind}, table_no int, row_no int, col_no int, text string")


def html_elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, tag, text and emphasised (whether some text stands in bold or italics) of headings, paragraphs, list items and rules."""
    from html.parser import HTMLParser

    shown, strong = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "hr"}, {"b", "strong", "em", "i"}

    class Elements(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.rows: list[tuple[int, str, str, bool]] = []
            self.tag, self.said, self.marked, self.depth = "", [], False, 0

        def close_element(self) -> None:
            if self.tag:
                self.rows.append((len(self.rows), self.tag, " ".join("".join(self.said).split()), self.marked))
            self.tag, self.said, self.marked = "", [], False

        def handle_starttag(self, tag: str, attrs) -> None:
            self.depth += tag in strong
            if tag in shown:
                self.close_element()
                self.tag = tag
                if tag == "hr":
                    self.close_element()

        def handle_endtag(self, tag: str) -> None:
            self.depth = max(0, self.depth - (tag in strong))
            if tag in shown or tag in ("div", "ul", "ol", "body"):
                self.close_element()

        def handle_data(self, data: str) -> None:
            self.said.append(data)
            self.marked = self.marked or (self.depth > 0 and bool(data.strip()))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, page in zip(batch[key], batch["_html"], strict=True):
                parser = Elements()
                parser.feed(page or "")
                parser.close()
                parser.close_element()
                out += [(k, *row) for row in parser.rows]
            yield pd.DataFrame(out, columns=[key, "pos", "tag", "text", "emphasised"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(html).alias("_html")).mapInPandas(read, f"{key} {kind}, pos int, tag string, text string, emphasised boolean")


def settings_map(raw: Column) -> Column:
    """NAME=value entries between NULs or line feeds as a map, the last of a name; exported functions are no entries."""
    entries = F.filter(F.split(raw, "[\x00\n]"), lambda e: F.contains(e, F.lit("=")) & ~F.startswith(e, F.lit("BASH_FUNC_")))
    pairs = F.transform(entries, lambda e: F.struct(F.substring_index(e, "=", 1).alias("k"), F.regexp_replace(e, "^[^=]*=", "").alias("v")))
    last = F.filter(pairs, lambda p: p["k"] != "")
    names = F.array_distinct(F.transform(last, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(last, lambda p: p["k"] == n), -1)["v"]))


def heading_hints(elements: DataFrame, key: str, ahead: int = 5) -> DataFrame:
    """For each heading element (key, pos, tag, text, emphasised): the label and performer lines among those after it.

    Elements without text do not count; the next heading or rule ends the search, as does the first
    label (what trailing parentheses hold, or follows 'label:') among the next ``ahead``. The performer is
    what stands before the parentheses, or the last emphasised paragraph before the label.
    """
    stops = F.col("tag").isin("h2", "h3", "hr")
    told = elements.where((F.trim("text") != "") | stops)
    group = F.sum(stops.cast("int")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = told.withColumn("group", group)
    at = F.row_number().over(Window.partitionBy(key, "group").orderBy("pos")) - 1
    rows = rows.withColumn("at", at).where(F.col("at") <= ahead)
    held = F.nullif(F.regexp_extract("text", r"\(([^)]+)\)$", 1), F.lit(""))
    label = F.coalesce(held, F.nullif(F.trim(F.regexp_extract("text", r"(?i)label:(.*)$", 1)), F.lit("")))
    rows = rows.withColumns({"label": F.when(F.col("at") > 0, label), "before": F.nullif(F.trim(F.regexp_replace("text", r"\([^)]+\)$", "")), F.lit("")), "held": held})
    rows = rows.withColumn("label_at", F.min(F.when(F.col("label").isNotNull(), F.col("at"))).over(Window.partitionBy(key, "group")))
    own = F.col("at") == F.col("label_at")
    strong = (F.col("at") > 0) & F.col("emphasised") & (F.col("tag") == "p") & (F.col("label_at").isNull() | (F.col("at") < F.col("label_at")))
    out = rows.groupBy(key, "group").agg(
        F.max(F.when((F.col("at") == 0) & F.col("tag").isin("h2", "h3"), F.col("text"))).alias("title"),
        F.max(F.when(own, F.col("label"))).alias("label"),
        F.max(F.when(own & F.col("held").isNotNull(), F.col("before"))).alias("_named"),
        F.max(F.when(strong, F.struct("at", "text"))).alias("_strong"),
    )
    related = F.contains("title", F.lit("Related Articles"))
    ended = F.max(related.cast("int")).over(Window.partitionBy(key).orderBy("group").rowsBetween(Window.unboundedPreceding, 0))
    found = out.where("title IS NOT NULL").withColumn("_ended", ended).where("_ended = 0")
    return found.select(key, "group", "title", F.coalesce("_named", F.col("_strong.text")).alias("performer"), "label")
