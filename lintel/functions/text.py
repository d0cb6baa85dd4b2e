"""Column functions on text: folding, tokens, token sets, phrases, names."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.functions import lexicon

SPACE = r"(?U)\s+"
CURLY = "’‘“”"
WIDE = r"[^\x00-\x7F]"
EDGES = r"^[ \-–—:;,.]+|[ \-–—:;,.]+$"


def texts(values) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lookup(table: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


@lru_cache(maxsize=1)
def _ascii_folds() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one ASCII character, what they fold to, and those that fold to several."""
    one_from, one_to, several = [], [], {}
    for code in range(0x80, 0x20000):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one_from.append(char)
            one_to.append(plain)
        elif plain:
            several[char] = plain
    return "".join(one_from), "".join(one_to), several


def _ranges(chars) -> str:
    """A character class of runs of consecutive characters."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in runs) + "]"


def bound(value: Column, make) -> Column:
    """What ``make`` makes of a value that is computed once, however often it names it."""
    return F.transform(F.array(value), make)[0]


def fold_ascii(text: Column, marks: tuple[str, str] = ("", "")) -> Column:
    """Compatibility decomposition with all but ASCII dropped; marks are characters, and what stands for each instead."""
    one_from, one_to, several = _ascii_folds()
    held = f"(?={WIDE})({_ranges(several)})"
    # one literal: hundreds of pairs, each an expression, would be planned anew with every text that is folded
    full_forms = F.str_to_map(F.lit("\x01".join(f"{c}\x02{plain}" for c, plain in several.items())), F.lit("\x01"), F.lit("\x02"))

    def spelled(wide: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(wide, F.lit(held), 1))
        full = F.aggregate(found, wide, lambda t, c: F.replace(t, c, F.element_at(full_forms, c)))
        return F.regexp_replace(full, WIDE, "")

    def folded(text: Column) -> Column:
        return bound(F.translate(text, marks[0] + one_from, marks[1] + one_to), lambda wide: F.when(wide.rlike(WIDE), spelled(wide)).otherwise(wide))

    return bound(text, lambda t: F.when(t.rlike(WIDE), folded(t)).otherwise(t))


def normalize(text: Column) -> Column:
    """Lower-case ASCII words separated by single spaces. Dashes outside ASCII vanish and join their neighbours."""
    plain = F.lower(fold_ascii(F.coalesce(text, F.lit("")), (CURLY, " " * len(CURLY))))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


#: Bytes of ASCII text: what is neither a letter nor a digit becomes a space.
_PLAIN = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 0x80 else 0x20 for b in range(256))


def _plain(raw: bytes) -> str:
    if not raw.isascii():
        wide = raw.decode("utf-8", "replace")
        for mark in CURLY:
            wide = wide.replace(mark, " ")
        raw = unicodedata.normalize("NFKD", wide).encode("ascii", "ignore")
    return b" ".join(raw.translate(_PLAIN).split()).decode("ascii")


def normalize_long(text: Column) -> Column:
    """What ``normalize`` makes of a text, in Arrow batches: for long texts of any alphabet, which built-in functions fold one character at a time."""

    @F.arrow_udf("string")
    def plain(texts: pa.Array) -> pa.Array:
        return pa.array((_plain(raw.as_py() or b"") for raw in texts.cast(pa.binary())), pa.string())

    return plain(text)


def normalize_symbols(text: Column) -> Column:
    """Lower-case ASCII with straight quotes; punctuation stays."""
    straight = fold_ascii(F.coalesce(text, F.lit("")), (CURLY, "''\"\""))
    return F.trim(F.regexp_replace(F.lower(straight), r"\s+", " "))


def words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def split_tokens(text: Column) -> Column:
    """Words in order, without stopwords and single characters; repeats stay."""
    return F.filter(words(normalize(text)), lambda t: (F.length(t) > 1) & ~F.array_contains(texts(lexicon.STOPWORDS), t))


def token_set(text: Column) -> Column:
    """Distinct words of three characters or more that are no stopwords."""
    return F.array_distinct(F.filter(words(normalize(text)), lambda t: (F.length(t) > 2) & ~F.array_contains(texts(lexicon.STOPWORDS), t)))


def token_set_of_all(values: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(values, token_set)))


def artist_tokens(values: Column) -> Column:
    return F.array_except(token_set_of_all(values), texts(lexicon.GENERIC_ARTIST_TOKENS))


def numbers_in(values: Column) -> Column:
    """Distinct whole numbers of an array of texts."""
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.regexp_extract_all(normalize_symbols(v), F.lit(r"\b(\d+)\b"), 1))))


def year_in(text: Column) -> Column:
    """The first year from 1900 to 2099, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(?:19|20)\d{2}\b", 0), F.lit(""))


def overlap(left: Column, right: Column) -> Column:
    """Share of the left set that is in the right one; 0 for an empty left set."""
    return F.when(F.size(left) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / F.size(left))


def phrase_overlap(left: Column, right: Column) -> Column:
    """Share of left values that equal, hold or are held by some right value, after normalising."""
    return plain_overlap(plain_phrases(left), plain_phrases(right))


def plain_phrases(values: Column) -> Column:
    """Normalised values without blank ones."""
    return F.filter(F.transform(values, normalize), lambda v: v != "")


def plain_overlap(left: Column, right: Column) -> Column:
    """``phrase_overlap`` of values that are normalised, without blank ones."""

    def share(held: Column, others: Column) -> Column:
        hits = F.size(F.filter(held, lambda v: F.exists(others, lambda o: F.contains(v, o) | F.contains(o, v))))
        return F.when(F.size(held) == 0, F.lit(0.0)).otherwise(hits / F.size(held))

    return bound(F.struct(left.alias("held"), right.alias("others")), lambda x: share(x["held"], x["others"]))


def instruments_in(text: Column) -> Column:
    """Words that name instruments, as spelled."""
    raw = F.transform(F.split(F.coalesce(text, F.lit("")), SPACE), lambda t: F.regexp_replace(t, "^[,;]+|[,;]+$", ""))
    return F.filter(raw, lambda t: F.array_contains(texts(lexicon.INSTRUMENTS), F.lower(t)))


def instrument_set(values: Column) -> Column:
    """Distinct canonical instrument names of an array of texts."""
    raw = F.flatten(F.transform(values, lambda v: words(normalize(v))))
    kept = F.filter(raw, lambda t: ~F.array_contains(texts(sorted({*lexicon.GENERIC_LINE_PREFIXES, *lexicon.SKIPPED_SEGMENTS})), t))
    return F.array_distinct(F.transform(kept, lambda t: F.coalesce(F.try_element_at(lookup(lexicon.INSTRUMENTS), t), t)))


def names_ensemble(text: Column) -> Column:
    long_hints = [h for h in lexicon.ENSEMBLE_HINTS if len(h) > 3]
    hinted = lambda plain: F.exists(texts(long_hints), lambda h: F.contains(plain, h)) | F.arrays_overlap(words(plain), texts(lexicon.ENSEMBLE_HINTS))
    return bound(normalize(text), hinted)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def merge_unique(values: Column) -> Column:
    """Values that differ after normalising, first spelling first; blank ones go."""
    squeezed = F.transform(values, lambda v: squeeze(F.coalesce(v, F.lit(""))))
    cleaned = F.transform(squeezed, lambda v: F.struct(v.alias("v"), normalize(v).alias("k")))
    empty = F.filter(cleaned, lambda x: F.lit(False))
    kept = F.aggregate(
        cleaned, empty, lambda acc, x: F.when((x["k"] == "") | F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x)))
    )
    return F.transform(kept, lambda x: x["v"])


def plain_inline(text: Column) -> Column:
    """Markdown without images, link targets and emphasis."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"!\[[^\]]*\]\([^)]*\)", " ")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return squeeze(F.regexp_replace(text, "[*_]", ""))


def without_line_prefixes(text: Column) -> Column:
    """Inline text without leading label words, longest first."""

    def known(text: Column) -> Column:
        return bound(text, lambda t: F.struct(t.alias("text"), normalize(t).alias("plain")))

    def strip(state: Column, prefix: Column) -> Column:
        rest = F.array_join(F.slice(F.split(state["text"], SPACE), F.size(F.split(prefix, " ")) + 1, 1_000_000), " ")
        return F.when(F.startswith(state["plain"], prefix), known(F.regexp_replace(rest, EDGES, ""))).otherwise(state)

    prefixes = texts(sorted(lexicon.GENERIC_LINE_PREFIXES, key=len, reverse=True))
    return F.aggregate(prefixes, known(plain_inline(text)), strip, lambda state: state["text"])


def pruned(values: Column, peers: Column) -> Column:
    """Values of which no peer is a proper part, after normalising; first of equals."""
    plain_peers = F.filter(F.transform(peers, normalize), lambda p: p != "")

    def kept(values: Column, plain_peers: Column) -> Column:
        return F.filter(values, lambda v: bound(normalize(v), lambda plain: ~F.exists(plain_peers, lambda p: F.contains(plain, p) & (plain != p))))

    return merge_unique(bound(plain_peers, lambda held: kept(values, held)))


def bold_headings(line: Column) -> Column:
    """Heading text without marks, images and bold."""
    text = F.regexp_replace(F.regexp_replace(line, "^#+", ""), r"!\[[^\]]*\]\([^)]*\)", "")
    return F.trim(F.replace(text, F.lit("**"), F.lit("")))


def italic_phrases(text: Column) -> Column:
    found = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("_([^_]+)_"), 1),
        lambda p: F.regexp_replace(plain_inline(p), EDGES, ""),
    )
    return merge_unique(F.filter(found, lambda p: (F.length(p) > 2) & ~normalize(p).isin(*lexicon.NO_WORKS)))


def review_slug(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)/review/([^)\s]+)", 1)


def chapter_title(stem: Column) -> Column:
    """A file stem without disc and track numbers, and its part after the last ' - '."""
    numbered = F.regexp_replace(F.regexp_replace(stem, r"^\d+-\d+[-.\s]+", ""), r"^\d+[-.\s]+", "")
    return F.trim(F.element_at(F.split(numbered, " - "), -1))


def escaped_metadata(value: Column) -> Column:
    """Backslashes first, then the separators of key=value files and line ends."""
    for char in "\\=;#":
        value = F.replace(value, F.lit(char), F.lit("\\" + char))
    return F.replace(value, F.lit("\n"), F.lit("\\n"))


def file_name(heading: Column) -> Column:
    """A heading as a file name."""
    text = F.replace(squeeze(heading), F.lit("/"), F.lit(" - "))
    text = squeeze(F.regexp_replace(text, r'[\[\]<>:"\\|?*]', ""))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("Untitled"))


def natural_key(name: Column) -> Column:
    """A string that sorts digit runs by value: each is led by its length."""
    lowered = F.lower(name)
    parts = F.regexp_extract_all(lowered, F.lit(r"(\d+|\D+)"), 1)
    sized = F.transform(
        parts,
        lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(F.regexp_replace(p, "^0+(?=.)", "")).cast("string"), 4, "0"), F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(p),
    )
    return F.array_join(sized, "\x01")


def heading_people(line: Column) -> Column:
    """Names of a heading: its bold parts, cut at '.', ';' and '/', or else its leading words in capitals."""
    bold = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(r"\*\*(.+?)\*\*"), 1)
    named = F.flatten(F.transform(bold, lambda b: F.split(plain_inline(b), r"\s*[.;/]\s*")))
    return bound(named, lambda n: merge_unique(F.when(F.exists(n, lambda v: F.trim(v) != ""), n).otherwise(F.array(capitals(line)))))


def capitals(line: Column) -> Column:
    """The leading words of a heading whose letters are all capitals."""
    shown = plain_inline(F.regexp_replace(F.coalesce(line, F.lit("")), r"^#{1,6}\s*", ""))
    return F.trim(F.regexp_extract(shown, r"^((?:[^a-z\s]*[A-Z][^a-z\s]*(?:\s+|$))+)", 1))


def heading_title(line: Column, fallback: Column) -> Column:
    """A heading without its names; the fallback if nothing is left."""
    bare = F.regexp_replace(F.coalesce(line, F.lit("")), r"^#{1,6}\s*", "")
    has_bold = bare.rlike(r"\*\*.+?\*\*")
    rest = F.when(has_bold, plain_inline(F.regexp_replace(bare, r"\*\*.+?\*\*", " "))).otherwise(F.substr(plain_inline(bare), F.length(capitals(line)) + 1))
    return F.coalesce(F.nullif(F.regexp_replace(rest, EDGES, ""), F.lit("")), fallback)


def slug_phrases(slug: Column, known: Column) -> Column:
    """A slug's words, and those of them that known phrases do not hold."""
    tokens = words(F.replace(F.coalesce(slug, F.lit("")), F.lit("-"), F.lit(" ")))
    rest = lambda held: F.filter(tokens, lambda t: ~F.array_contains(held, normalize(t)))
    return merge_unique(F.array(F.array_join(tokens, " "), F.array_join(bound(token_set_of_all(known), rest), " ")))


def without_instruments(text: Column, instruments: Column) -> Column:
    """Inline text without words that are, or stand for, listed instruments."""
    def named(token: Column, listed: Column) -> Column:
        meant = lambda plain: F.coalesce(F.try_element_at(lookup(lexicon.INSTRUMENTS), plain), plain)
        return bound(normalize(token), lambda plain: F.array_contains(listed, plain) | F.array_contains(listed, normalize(meant(plain))))

    tokens = F.split(plain_inline(text), " ")
    rest = bound(F.transform(instruments, normalize), lambda listed: F.filter(tokens, lambda t: ~named(t, listed)))
    return F.regexp_replace(F.array_join(rest, " "), EDGES, "")


def unlike(values: Column, *titles: Column) -> Column:
    """Values that do not equal a title after normalising; first of equals."""
    merged = merge_unique(values)
    return bound(F.array(*[normalize(t) for t in titles]), lambda plain: F.filter(merged, lambda v: ~F.array_contains(plain, normalize(v))))
