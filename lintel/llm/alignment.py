"""Alignment of two tokenizers by a sweep over the ends of their tokens.

A text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Where a token ends is an
event; an event's offset is the bytes that the tokens up to it hold, so events travel as ids, packed by
stretches of ``STRETCH`` bytes. The events of both sides are dealt by document, sorted by offset within
partitions, and one pass over a partition cuts groups where both sides end. Between two stretches it
holds the tokens of the group that is open and the digest so far, however long the text is.

Tokens that end together are linked. Links are counted over all documents: a task adds up what it
holds before it shuffles, the best partner of each B token is a window over its pairs. The counts go
back to the documents: pairs with more than one in ``OFTEN`` of all links (fewer than ``OFTEN`` pairs)
are broadcast, the others are joined by a shuffle in which none is frequent.

Defined results: null and empty texts, and those whose tokens' bytes differ from a space and the text,
have no tokens, zeros and an empty groups_sha256; an id may be null or repeat, each row counts by
itself; an empty table gives an empty result; other columns are ignored whatever their names. Strings
of special tokens inside texts are plain text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import written

#: Bytes of text whose events travel in one row, and texts that are encoded together.
STRETCH = 1 << 15
TEXTS_AT_ONCE = 64
#: Links that a task holds before it hands on their counts, or one part of a document's links.
HELD_LINKS = 1 << 21
OFTEN = 1_000_000
#: A pair of ids as one number.
B_SPAN = 1 << 32
#: Characters whose classes have stood since early Unicode: the fast encoder and the library split them alike.
_SETTLED = re.compile("[^\x00-ɏ‐-…€]")

EVENTS = "row long, doc_id long, stretch int, side byte, ids binary"
SWEPT = "row long, doc_id long, part int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it shows, else the next letter from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class ByteSide:
    """A byte-level vocabulary file: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["id"] for t in model.get("added_tokens", [])}
        vocabulary = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if i not in special}
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *special]))
        for b, i in vocabulary.items():
            self.bytes[i] = b
        words = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        # ids rise with the order of merges, so they serve as ranks
        self.fast = tiktoken.Encoding("side", pat_str=words, mergeable_ranks=vocabulary, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None if _SETTLED.search(t) else self.fast.encode_ordinary(t) for t in texts]
        others = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(others, self.library.encode_batch([texts[k] for k in others], add_special_tokens=False), strict=True):
            out[k] = found.ids
        return out


class PieceSide:
    """A piece model file: ids of texts, and the bytes of each id; a space goes ahead of a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(self.library.get_piece_size())
        held = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) for i in size]
        pieces = [self.library.id_to_piece(i) for i in size]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else b"" if held[i] else p.replace("▁", " ").encode() for i, p in zip(size, pieces, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def sides(byte_path: str, piece_path: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(byte_path), PieceSide(piece_path)


def _packed(numbers: np.ndarray, kind: type) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.astype(kind).tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def token_events(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """The ends of both sides' tokens: row, doc_id, stretch, side (0: A, 1: B) and ids; a text without tokens has one row of no side."""

    def events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = sides(byte_path, piece_path)
        lengths = [np.array([len(b) for b in s.bytes], np.int64) for s in both]
        columns = ["row", "doc_id", "stretch", "side", "ids"]
        for batch in batches:
            for lo in range(0, len(batch), TEXTS_AT_ONCE):
                some, out = batch.iloc[lo : lo + TEXTS_AT_ONCE], []
                texts = [t or "" for t in some["text"]]
                encoded = zip(both[0].encode([" " + t for t in texts]), both[1].encode(texts), strict=True)
                for row, doc_id, text, found in zip(some["row"], some["doc_id"], texts, encoded, strict=True):
                    wanted = b" " + text.encode("utf-8", "surrogatepass")
                    if not text or any(b"".join(map(s.bytes.__getitem__, ids)) != wanted for s, ids in zip(both, found, strict=True)):
                        out.append((row, doc_id, 0, -1, None))
                        continue
                    for side, ids in enumerate(found):
                        numbers = np.array(ids, np.int64)
                        at = (np.cumsum(lengths[side][numbers]) - 1) // stretch
                        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
                        out.extend((row, doc_id, int(at[a]), side, _packed(numbers[a:b], np.uint16 if len(lengths[side]) <= 1 << 16 else np.uint32)) for a, b in zip(cuts, cuts[1:], strict=False))
                yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInPandas(events, EVENTS)


class _Sweep:
    """What is known of the document under the sweep: its open group, digest and sums."""

    def __init__(self, both: tuple[ByteSide, PieceSide]):
        self.lengths = [np.array([len(b) for b in s.bytes], np.int64) for s in both]
        self.kinds = [np.uint16 if len(x) <= 1 << 16 else np.uint32 for x in self.lengths]
        sizes = [len(x) for x in self.lengths]
        #: Decimal ids of A, then of B; followed by a comma, then by what ends the group's side.
        self.spelled = [f"{i}{end}" for end in (",", "|") for i in range(sizes[0])] + [f"{i}{end}" for end in (",", ";") for i in range(sizes[1])]
        self.sizes = sizes
        self.begin(-1, None)

    def begin(self, row: int, doc_id: int | None) -> None:
        self.row, self.doc_id, self.part = row, doc_id, 0
        self.stretch = -1
        self.open = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.at = 0  # where the open group begins
        self.n = [0, 0]
        self.groups = 0
        self.digest, self.held = hashlib.sha256(), ""
        self.links: list[np.ndarray] = []
        self.n_held = 0

    def add(self, side: int, data: bytes) -> None:
        ids = _unpacked(data, self.kinds[side]).astype(np.int64)
        self.n[side] += len(ids)
        self.open[side] = np.concatenate([self.open[side], ids])

    def close_groups(self) -> None:
        """Groups that end within what has come; the rest stays open."""
        a, b = self.open
        ends_a, ends_b = (np.cumsum(x[i]) for x, i in zip(self.lengths, (a, b), strict=True))
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not len(shared):
            return
        last_a, last_b = np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)
        stop_a, stop_b = int(last_a[-1]) + 1, int(last_b[-1]) + 1
        of_a, of_b = np.searchsorted(shared, ends_a[:stop_a]), np.searchsorted(shared, ends_b[:stop_b])
        codes = np.empty(stop_a + stop_b, np.int64)
        says_a, says_b = a[:stop_a].copy(), b[:stop_b] + 2 * self.sizes[0]
        says_a[last_a] += self.sizes[0]
        says_b[last_b] += self.sizes[1]
        codes[np.arange(stop_a) + np.concatenate([[0], last_b + 1])[of_a]] = says_a
        codes[np.arange(stop_b) + (last_a + 1)[of_b]] = says_b
        text = self.held + "".join(map(self.spelled.__getitem__, codes.tolist()))
        self.digest.update(text[:-1].encode())
        self.held = text[-1]  # the last group has no semicolon
        self.groups += len(shared)
        self.links.append(a[last_a] * B_SPAN + b[last_b])
        self.n_held += len(shared)
        self.open = [a[stop_a:], b[stop_b:]]

    def linked(self) -> tuple[bytes, bytes]:
        pairs, times = np.unique(np.concatenate(self.links), return_counts=True) if self.links else (np.zeros(0, np.int64),) * 2
        self.links, self.n_held = [], 0
        return _packed(pairs, np.int64), _packed(times, np.int32)

    def part_row(self) -> tuple:
        self.part += 1
        return (self.row, self.doc_id, self.part, None, None, None, None, None, *self.linked())

    def last_row(self) -> tuple:
        return (self.row, self.doc_id, 0, *self.n, self.groups, self.groups, self.digest.hexdigest() if self.groups else "", *self.linked())


def swept(events: DataFrame, byte_path: str, piece_path: str, held_links: int = HELD_LINKS) -> DataFrame:
    """One row of each document with its counts and digest (part 0), and further parts of its links if those are many."""

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = _Sweep(sides(byte_path, piece_path))
        columns = [c.split()[0] for c in SWEPT.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")})

        for batch in batches:
            out = []
            for row, doc_id, stretch, side, ids in zip(batch["row"], batch["doc_id"].astype("Int64"), batch["stretch"], batch["side"], batch["ids"], strict=True):
                if row != now.row:
                    if now.row >= 0:
                        now.close_groups()
                        out.append(now.last_row())
                    now.begin(row, doc_id)
                elif stretch != now.stretch:
                    now.close_groups()
                    if now.n_held >= held_links:
                        out.append(now.part_row())
                now.stretch = stretch
                if side >= 0:
                    now.add(side, ids)
            if out:
                yield frame(out)
        if now.row >= 0:
            now.close_groups()
            yield frame([now.last_row()])

    return events.repartition("row").sortWithinPartitions("row", "stretch", "side").mapInPandas(sweep, SWEPT)


def pair_counts(links: DataFrame, held_links: int = HELD_LINKS) -> DataFrame:
    """pair, its number of links n in all documents, and best: whether no pair of the same B token has more."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, times, held = [], [], 0

        def counted() -> pd.DataFrame:
            found, place = np.unique(np.concatenate(pairs), return_inverse=True)
            return pd.DataFrame({"pair": found, "n": np.bincount(place, np.concatenate(times), len(found)).astype(np.int64)})

        for batch in batches:
            for p, t in zip(batch["pairs"], batch["times"], strict=True):
                pairs.append(_unpacked(p, np.int64))
                times.append(_unpacked(t, np.int32))
                held += len(pairs[-1])
                if held >= held_links:
                    yield counted()
                    pairs, times, held = [], [], 0
        if pairs:
            yield counted()

    counts = links.select("pairs", "times").mapInPandas(add_up, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair") % F.lit(B_SPAN))  # as many rows as A has ids at most
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best"))


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", often: int = OFTEN, stretch: int = STRETCH, held_links: int = HELD_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    documents = written(swept(token_events(docs, byte_path, piece_path, id_col, text_col, stretch), byte_path, piece_path, held_links))
    counts = written(pair_counts(documents, held_links))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = total // often
    known = counts.where(F.col("n") > bound).orderBy("pair").toPandas()  # fewer than ``often`` pairs
    shared = docs.sparkSession.sparkContext.broadcast((known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, n, best = shared.value
        for batch in batches:
            sums, bests, rest, rest_times = [], [], [], []
            for p, t in zip(batch["pairs"], batch["times"], strict=True):
                p, t = _unpacked(p, np.int64), _unpacked(t, np.int32).astype(np.int64)
                at = np.searchsorted(pairs, p)
                hit = at < len(pairs)
                hit[hit] = pairs[at[hit]] == p[hit]
                sums.append(int((n[at[hit]] * t[hit]).sum()))
                bests.append(int(t[hit][best[at[hit]]].sum()))
                rest.append(p[~hit])
                rest_times.append(t[~hit])
            yield batch.drop(columns=["pairs", "times"]).astype({c: "Int64" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}).assign(count_sum=sums, n_best=bests, pairs=rest, times=rest_times)

    kept = ", ".join(c for c in SWEPT.split(", ") if c.split()[0] not in ("pairs", "times"))
    partly = written(documents.mapInPandas(look_up, f"{kept}, count_sum long, n_best long, pairs array<long>, times array<long>"))
    rest = partly.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    seldom = rest.join(counts.where(F.col("n") <= bound), "pair").select("row", (F.col("n") * F.col("times")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    added = seldom.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    both = partly.select("row", *columns, "count_sum", "n_best").unionByName(added, allowMissingColumns=True)
    summed = both.groupBy("row").agg(*[F.max(c).alias(c) for c in columns], F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return summed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
