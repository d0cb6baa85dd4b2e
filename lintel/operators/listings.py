"""Paged listings: pages followed along their links in order, items of all pages, and lookups that keep the items' order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.operators.runs import first_of_each, numbered
from lintel.operators.shared import written


def followed(pages: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """listing, link, depth and place of the pages that each listing (listing, link) reaches, in the order of reading.

    ``pages`` holds link, status, items and next (links, in order). A listing goes round by round from the links of one round's
    pages to the next round's, in the order of the pages and of the links on them; it reads a link once. A page that is not
    there, or whose status is not 200, is not read and leads nowhere. ``most`` bounds the rounds after the first. A round
    numbers its rows over range partitions, so a listing may hold a large share of all pages.
    """
    good = pages.where("status = 200").select("link", "next")
    front = written(numbered(first_of_each(starts.select("listing", "link"), ["listing", "link"], "link"), "place", "listing", "link"))
    seen, depth, found = None, 0, []
    while True:
        read = written(front.join(good, "link").select("listing", "link", F.lit(depth).alias("depth"), "place", "next"))
        if read.isEmpty():
            break
        found.append(read.drop("next"))
        if most is not None and depth >= most:
            break
        reached = front.select("listing", "link")  # read or not: a link is asked once
        seen = reached if seen is None else seen.unionAll(reached)
        led = read.select("listing", F.col("place").alias("from"), F.posexplode("next").alias("nth", "link")).where("link IS NOT NULL")
        fresh = first_of_each(led.join(seen, ["listing", "link"], "left_anti"), ["listing", "link"], "from", "nth")
        front = written(numbered(fresh, "place", "listing", "from", "nth").select("listing", "link", "place"))
        depth += 1
    out = found[0] if found else read.drop("next")
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def listed_items(pages: DataFrame, read: DataFrame) -> DataFrame:
    """listing, depth, place, nth and item of all items of the pages that were read; repeats stay."""
    return read.join(pages.select("link", "items"), "link").select("listing", "depth", "place", F.posexplode("items").alias("nth", "item")).where("item IS NOT NULL")


def distinct_items(items: DataFrame) -> DataFrame:
    """listing, item and the place where it comes first."""
    first = F.min(F.struct("depth", "place", "nth")).alias("first")
    return items.groupBy("listing", "item").agg(first).select("listing", "item", "first.*")


def offset_links(pages: DataFrame) -> DataFrame:
    """Pages of listings by offset (listing, offset, status, items, total) as linked pages.

    A page is followed by the one at its offset and number of items, unless it has none or the total is reached. The total is
    what the listing's first good page that says one says.
    """
    said = F.min(F.when((F.col("status") == 200) & F.col("total").isNotNull(), F.struct("offset", "total")))
    totals = pages.groupBy("listing").agg(said.getField("total").alias("_total"))
    link = lambda offset: F.concat_ws("@", F.col("listing").cast("string"), offset.cast("string"))
    after = F.col("offset") + F.size("items")
    more = (F.size("items") > 0) & (F.col("_total").isNull() | (after < F.col("_total")))
    none = F.array().cast("array<string>")
    return pages.join(totals, "listing").select(link(F.col("offset")).alias("link"), "status", "items", F.when(more, F.array(link(after))).otherwise(none).alias("next"))


def last_responses(responses: DataFrame, key: str, order: str) -> DataFrame:
    """The last response about each key that did not fail (``status`` 200); its row stands for the key."""
    rest = [c for c in responses.columns if c != key]
    last = responses.where("status = 200").groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_l"))
    return last.select(key, *[F.col(f"_l.{c}") for c in rest])


def first_albums(items: DataFrame, responses: DataFrame, track: str = "track", order: str = "response") -> DataFrame:
    """The items, in their order and with their repeats, with the first album of their track's last response; others go.

    Tracks are joined as they come, and a track that many items name is split by the runtime like any skewed join.
    """
    known = last_responses(responses, track, order).select(track, F.get("albums", F.lit(0)).alias("album")).where("album <> ''")
    return items.join(known, track)


def uniform_groups(rows: DataFrame, keys: list[str], parameters: list[str]) -> DataFrame:
    """keys, uniform, rows and variants (the distinct tuples of parameters as text, in order) of each group.

    A group with more than one tuple is to be rejected. Rows whose parameters are all null say nothing; a group of only such
    rows has no variant and is rejected as well. Tuples are counted before they meet, so a group may hold most rows.
    """
    known = F.coalesce(*[F.col(p).isNotNull().cast("int") for p in parameters]) if len(parameters) == 1 else F.greatest(*[F.col(p).isNotNull().cast("int") for p in parameters])
    shown = F.concat_ws("/", *[F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parameters])
    tuples = rows.select(*keys, F.when(known == 1, shown).alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    groups = tuples.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("variants"), F.sum("_n").alias("rows"))
    return groups.select(*keys, (F.size("variants") == 1).alias("uniform"), "rows", "variants")


def observed_rejections(groups: DataFrame, name: str = "uniformity"):
    """The groups, and an observation that tells after they are used how many there were and how many were rejected."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return groups.observe(seen, F.count(F.lit(1)).alias("groups"), F.count_if(~F.col("uniform")).alias("rejected")), seen


def rejected_last(rows: DataFrame, groups: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of uniform groups, and those of the others with the variants that they were rejected for."""
    met = rows.join(groups.select(*keys, "uniform", "variants"), keys)
    return met.where("uniform").select(*rows.columns), met.where("NOT uniform").select(*rows.columns, "variants")


def in_order(items: DataFrame, *order: str) -> DataFrame:
    """listing and items: whole listings as arrays, for listings that a row can hold."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "item")))
    return items.groupBy("listing").agg(F.transform(parts, lambda x: x["item"]).alias("items"))


def place_in_listing(items: DataFrame, *order: str) -> DataFrame:
    return items.withColumn("position", F.row_number().over(Window.partitionBy("listing").orderBy(*order)) - 1)
