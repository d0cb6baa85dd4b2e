"""Main text of web pages: markup zones, and a host suffix array for what markup leaves open.

A page is read once into blocks. Parts that markup names as something else (menus, footers, adverts,
forms, scripts, comments and so on) go. The other blocks lie in an article (or main) element or
outside of all. A page with one article, or a main element, has its text there, however short it is.
On other pages blocks outside are judged by their host: the token streams of its pages are
concatenated, a suffix array by prefix doubling brings equal substrings together, and substrings of
``MIN_RUN`` tokens on ``MIN_PAGES`` distinct pages of the host or more are boilerplate; what it covers
goes, unique runs stay. Where a page has several articles, or only such as lie within a part that names
itself something else, those are its text if they hold as much as the uncovered runs; otherwise the
uncovered runs are. A page that lies in a form as a whole, without an article, is read as if the form were not there.

Pages of a host whose texts are equal (or whose articles are) count as one page, so copies make
no boilerplate. A host's pages go through the array in batches of ``BATCH_PAGES``, and the pages that hold
a substring are added up over all batches of the host, so neither batches nor salts show in the result.
The pages of frequent hosts are dealt over as many salts as they fill batches, no other host has more
pages than a batch; a host streams through its task and is never held whole.

Defined results: null html counts as empty, whose text is the empty string; a null url is the host
of its own name; an empty table gives an empty result; rows that repeat give a row each; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import cut, frequent_keys

#: Tokens of a repeated substring, and the distinct pages of a host that make it boilerplate.
MIN_RUN = 8
MIN_PAGES = 5
BATCH_PAGES = 500

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SKIPPED = frozenset("head title nav footer script style noscript template iframe object svg button select textarea dialog menu canvas audio video map".split())
#: Skipped as well, but for articles that they hold.
_HOLDERS = frozenset(["aside", "form"])
_ZONES = frozenset(["article", "main"])
#: Elements that carry text themselves: in an article their classes say nothing.
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption".split())
_ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo adsbygoogle".split())
_COMMENTS = frozenset("comment comments disqus replies reply".split())
#: Parts with small articles of their own.
_TEASERS = frozenset("related recommended".split())
#: What is put into an article and named by a part of a class.
_INSERTS = frozenset("cookie cookies consent gdpr newsletter subscribe signup".split())
_NAMES = _ADVERTS | _COMMENTS | _TEASERS | frozenset(
    "banner cookie cookies consent gdpr notice sidebar menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social newsletter"
    " subscribe signup popup modal overlay widget rail pagination pager toolbar login".split()
)
#: A class that begins or ends so says how a wrapper looks, not what it is.
_MODIFIES = frozenset("has no with without is not hide show enable disable".split())
_NEGATES = frozenset("none off disabled left right top bottom open closed".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
#: Quotes count only where a value begins.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?)*+)>|<[!?/][^>]*>|<[A-Za-z/!?][^>]*\Z")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<![^\s/])(hidden)(?![^\s/])")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[_\-:]+|(?<=[a-z])(?=[A-Z])")

#: How an element is read: as it stands, never, or not unless it holds an article.
READ, NEVER, ARTICLES_ONLY = range(3)
#: Where a block lies: outside all articles, in one, or in one within a part that names itself something else.
OUTSIDE, INSIDE, ENCLOSED = range(3)


def _class_words(value: str) -> set[str]:
    """Words of the names in a class or id that say what a part is."""
    out: set[str] = set()
    for name in value.split():
        parts = [w.lower() for w in _PARTS.split(name) if w]
        if parts and parts[0] not in _MODIFIES and parts[-1] not in _NEGATES:
            out.update(parts)
    return out


def _reading(tag: str, attributes: str, in_zone: bool, forms: bool = False) -> int:
    """READ, NEVER or ARTICLES_ONLY, by the element's name and attributes; with forms, a form outside of articles is read."""
    if tag in _SKIPPED or (tag == "header" and not in_zone) or (tag in _HOLDERS and in_zone):
        return NEVER
    if tag == "form" and forms:
        return READ
    out = ARTICLES_ONLY if tag in _HOLDERS else READ
    if not attributes or tag in ("html", "body"):
        return out
    for found in _ATTRIBUTE.finditer(attributes):
        if found[5]:
            return NEVER
        key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if key in ("class", "id"):
            if tag in _ZONES:
                if _class_words(value) & (_COMMENTS | _ADVERTS):
                    return NEVER
            elif in_zone:
                # in an article only a container that bears exactly such a name, or one that comments, adverts and inserts are named by
                exact = (_NAMES - {"widget"}).intersection(value.lower().split())
                if tag not in _TEXTS and (exact or _class_words(value) & (_COMMENTS | _ADVERTS | _INSERTS)):
                    return NEVER
            else:
                words = _class_words(value)
                if words & (_COMMENTS | _TEASERS):
                    return NEVER
                if words & _NAMES or "header" in words:
                    out = ARTICLES_ONLY
        elif key == "hidden" or (key == "role" and value.lower() in _ROLES) or (key == "aria-hidden" and value.lower() == "true"):
            return NEVER
        elif key == "style" and "display:none" in value.replace(" ", "").lower():
            return NEVER
    return out


def page_blocks(page: str | None) -> list[tuple[int, str]]:
    """The blocks of a page in order, without parts that markup names as something else; each with where it lies."""
    return [(place, text) for place, _, _, text in _blocks(page) or _blocks(page, forms=True)]


def page_parts(page: str | None) -> tuple[str, list[str], bool]:
    """The articles' text, the blocks outside, and whether the articles are the main text whatever lies outside."""
    blocks = _blocks(page) or _blocks(page, forms=True)
    inside = [b for b in blocks if b[0] == INSIDE]
    sure = len({zone for _, zone, _, _ in inside}) == 1 or any(main for _, _, main, _ in inside)
    told = inside or [b for b in blocks if b[0] == ENCLOSED]
    if sure and any(main for _, _, main, _ in inside):
        told = [b for b in inside if b[2]]
    return " ".join(b[3] for b in told), [b[3] for b in blocks if b[0] == OUTSIDE], sure


def _blocks(page: str | None, forms: bool = False) -> list[tuple[int, int, bool, str]]:
    """Place, number of the outermost article, whether that is a main element, and text of each block."""
    page = _RAW.sub("", page or "")  # they hold no space
    blocks: list[tuple[int, int, bool, str]] = []
    zones, is_main = 0, False
    current: list[str] = []
    stack: list[str] = []
    skip_from = zone_from = 0  # depth at which skipping or the article began; 0: outside
    soft = False  # an article in the skipped part is read
    enclosing = 0  # depth of the skipped part around the present article

    def flush() -> None:
        if current:
            text = _SPACE.sub(" ", entities.unescape("".join(current))).strip()
            if text:
                blocks.append(((ENCLOSED if enclosing else INSIDE) if zone_from else OUTSIDE, zones, is_main and zone_from > 0, text))
            current.clear()

    last = 0
    for found in _TAG.finditer(page):
        if not skip_from and found.start() > last:
            current.append(page[last : found.start()])
        last = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        inline = tag in _INLINE
        if not skip_from:
            if tag == "br":
                current.append(" ")
            elif not inline:
                flush()
        if tag in _VOID:
            continue
        if inline:
            # inline elements do not nest into the stack, but for those that begin a skipped part and their like inside it
            if found[1]:
                if skip_from and stack[-1] == tag:
                    stack.pop()
                    skip_from = skip_from if len(stack) >= skip_from else 0
            elif skip_from:
                if stack[skip_from - 1] == tag:
                    stack.append(tag)
            elif found[3] and not found[3].endswith("/") and _reading(tag, found[3], zone_from > 0, forms) != READ:
                flush()
                stack.append(tag)
                skip_from, soft = len(stack), False
            continue
        if found[1]:
            if tag in stack:
                del stack[len(stack) - 1 - stack[::-1].index(tag) :]
                skip_from = skip_from if len(stack) >= skip_from else 0
                if zone_from > len(stack):
                    zone_from = 0
                    if enclosing:
                        skip_from, soft, enclosing = (enclosing if len(stack) >= enclosing else 0), True, 0
            continue
        if found[3].endswith("/") and tag not in ("script", "style"):
            continue
        stack.append(tag)
        if not skip_from:
            reading = _reading(tag, found[3], zone_from > 0, forms)
            if reading != READ:
                skip_from, soft = len(stack), reading == ARTICLES_ONLY
            elif tag in _ZONES and not zone_from:
                zone_from, zones, is_main = len(stack), zones + 1, tag == "main"
        elif soft:
            if tag in _ZONES and _reading(tag, found[3], False) == READ:
                zone_from, enclosing, skip_from, zones, is_main = len(stack), skip_from, 0, zones + 1, tag == "main"
            elif _reading(tag, found[3], False) == NEVER:
                skip_from, soft = len(stack), False
    if not skip_from and last < len(page):
        current.append(page[last:])
    flush()
    return blocks


def token_numbers(tokens: list[str]) -> np.ndarray:
    """A 64-bit hash of each token, the same on every page."""
    import xxhash

    known: dict[str, int] = {}
    for t in tokens:
        if t not in known:
            known[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def run_hashes(tokens: np.ndarray, size: int = MIN_RUN) -> np.ndarray:
    """A hash of every substring of ``size`` tokens, by its start."""
    n = max(0, len(tokens) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n]
    return out.view(np.int64)


def repeated_runs(streams: list[np.ndarray], min_run: int = MIN_RUN, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the substrings of min_run tokens that lie on at least so many of the streams, and on how many.

    Prefix doubling up to min_run tokens yields the suffix array as far as that many tokens tell suffixes apart.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    total = int(sizes.sum())
    none = np.zeros(0, np.int64)
    if total < min_run:
        return none, none
    tokens = np.concatenate(streams)
    page = np.repeat(np.arange(len(streams)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    length = 1
    while length < min_run:  # ranks of substrings twice as long, at most min_run; they stop at the page's end
        step = min(length, min_run - length)
        after = np.full(total, -1, np.int64)
        inside = np.arange(total) + step < ends
        after[inside] = rank[np.flatnonzero(inside) + step]
        _, rank = np.unique(rank * (total + 1) + after + 1, return_inverse=True)
        length += step
    order = np.argsort(rank, kind="stable")
    order = order[order + min_run <= ends[order]]
    if not len(order):
        return none, none
    same = rank[order][1:] == rank[order][:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    fresh = np.concatenate([[True], ~same | (page[order][1:] != page[order][:-1])])
    pages = np.bincount(group, fresh).astype(np.int64)
    first = order[np.concatenate([[True], ~same])][pages >= least]
    spans = tokens[first[:, None] + np.arange(min_run)]
    hashes = np.array([run_hashes(s, min_run)[0] for s in spans], np.int64)
    return hashes, pages[pages >= least]


def covered(tokens: np.ndarray, boilerplate: np.ndarray, min_run: int = MIN_RUN) -> np.ndarray:
    """Which tokens lie in a substring of min_run tokens whose hash is among the (sorted) boilerplate."""
    edge = np.zeros(len(tokens) + 1, np.int64)
    hashes = run_hashes(tokens, min_run)
    if len(hashes) and len(boilerplate):
        at = np.minimum(np.searchsorted(boilerplate, hashes), len(boilerplate) - 1)
        starts = np.flatnonzero(boilerplate[at] == hashes)
        edge[starts] += 1
        edge[starts + min_run] -= 1
    return np.cumsum(edge[:-1]) > 0


def vote(articles: str, outside: list[str], boilerplate: np.ndarray, sure: bool = False) -> str:
    """The articles' text, or, unless they are sure, the uncovered runs outside of them where those hold more tokens."""
    if sure:
        return articles
    tokens = [t for block in outside for t in block.split(" ")]
    kept = [t for t, c in zip(tokens, covered(token_numbers(tokens), boilerplate).tolist(), strict=True) if not c]
    return articles if articles and len(articles.split(" ")) >= len(kept) else " ".join(kept)


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, host, and each page's articles as one text, whether they are sure, its other blocks, and a hash of what makes it distinct; cut."""

    @F.pandas_udf("articles string, outside array<string>, sure boolean, identity long")
    def read(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        rows = []
        for page in texts:
            articles, outside, sure = page_parts(page)
            identity = xxhash.xxh64_intdigest((articles or "\n".join(outside)).encode("utf-8", "surrogatepass"))
            rows.append((articles, outside, sure, identity - (1 << 63)))
        return pd.DataFrame(rows, columns=["articles", "outside", "sure", "identity"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), read(F.col(html_col)).alias("read"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))
    return cut(rows.select("page_id", "url", host.alias("host"), "read.*"))


def host_boilerplate(rows: DataFrame, salts: DataFrame, min_pages: int = MIN_PAGES, batch_pages: int = BATCH_PAGES) -> DataFrame:
    """host and run: the hashes of substrings on enough distinct pages of a host."""
    distinct = rows.groupBy("host", "identity").agg(F.min("outside").alias("outside"))  # copies go before they meet
    salt = F.coalesce(F.pmod("identity", "salts"), F.lit(0))
    # only a host with salts may have pages in another batch
    dealt = distinct.join(F.broadcast(salts), "host", "left").select("host", salt.alias("salt"), F.col("salts").isNotNull().alias("split"), "outside")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, waiting = None, []

        def counted() -> pd.DataFrame:
            runs, pages = repeated_runs(waiting, least=1 if key[2] else min_pages)
            return pd.DataFrame({"host": key[0], "run": runs, "pages": pages})

        for batch in batches:
            for host, salt, split, outside in zip(batch["host"], batch["salt"], batch["split"], batch["outside"], strict=True):
                if (host, salt, split) != key or (split and len(waiting) >= batch_pages):
                    if waiting:
                        yield counted()
                    key, waiting = (host, salt, split), []
                waiting.append(token_numbers([t for block in outside for t in block.split(" ")]))
        if waiting:
            yield counted()

    found = dealt.repartition("host", "salt").sortWithinPartitions("host", "salt").mapInPandas(count, "host string, run long, pages long")
    return found.groupBy("host", "run").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= min_pages).select("host", "run")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, batch_pages: int = BATCH_PAGES) -> DataFrame:
    """page_id, url, text and n_chars; one row per input row."""
    parsed = parsed_pages(pages, id_col, url_col, html_col)
    # pages that are sure are no page of the array: what they hold outside is not looked at, but it counts
    open_pages = parsed.where(F.size("outside") > 0)
    done = parsed.where((F.size("outside") == 0) | F.col("sure")).select("page_id", "url", F.col("articles").alias("text"))

    often, _ = frequent_keys(open_pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "n", batch_pages)
    salts = often.select("host", F.ceil(F.col("n") / batch_pages).cast("int").alias("salts"))  # bounded by frequent_keys
    boilerplate = cut(host_boilerplate(open_pages, salts, min_pages, batch_pages))

    # each host's boilerplate streams by ahead of its pages, once for every salt
    every = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - F.lit(1))
    first = boilerplate.join(F.broadcast(salts), "host", "left").select("host", F.explode(every).alias("salt"), "run")
    numbered = open_pages.where("NOT sure").withColumn("number", F.monotonically_increasing_id()).join(F.broadcast(salts), "host", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("number"), F.col("salts")).cast("int"), F.lit(0))
    page = F.struct(F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "url", "articles", "outside")
    pages_of = numbered.select("host", salt.alias("salt"), F.lit(0).cast("long").alias("run"), page.alias("page"))
    both = first.withColumn("page", F.lit(None).cast(pages_of.schema["page"].dataType)).unionAll(pages_of)
    both = both.select("host", "salt", F.col("page").isNotNull().alias("is_page"), "run", "page.*")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, runs, known = None, [], None
        for batch in batches:
            texts = []
            for host, salt, is_page, run, articles, outside in batch[["host", "salt", "is_page", "run", "articles", "outside"]].itertuples(index=False):
                if (host, salt) != key:
                    key, runs, known = (host, salt), [], None
                if not is_page:
                    runs.append(run)
                    continue
                if known is None:
                    known = np.sort(np.array(runs, np.int64))
                texts.append(vote(articles, list(outside), known))
            yield batch.loc[batch["is_page"].astype(bool), ["none", "page_id", "url"]].assign(text=texts)

    ordered = both.repartition("host", "salt").sortWithinPartitions("host", "salt", "is_page")
    judged = ordered.mapInPandas(judge, "none boolean, page_id long, url string, text string")
    judged = judged.select(F.when(~F.col("none"), F.col("page_id")).alias("page_id"), "url", "text")
    return done.unionAll(judged).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
