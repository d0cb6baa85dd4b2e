"""Packing of tokenised documents into sequences by bounded-space online best fit.

Documents are tokenised, ended with a separator and cut into pieces of at most one sequence. The
pieces are dealt over parts by a hash of their place in the cut table (not of their document, which many
rows may share), in parts of about ``PIECES_PER_PART``, and each part is packed on its own as its pieces come, in random waves, the longest of a wave first: a
fixed number of bins is open, a bitset keyed by
free space names the tightest bin that still fits, and when no more bins may open the fullest one
closes. Pieces that fill a sequence pass through.

Defined results: null or empty text gives one piece that holds the separator alone; a null id is
dealt like any other; an empty table gives an empty result; rows that repeat are packed each; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import cut
from lintel.llm.merge_rounds import PairTable

SEQUENCE = 2048
SEPARATOR = 0
#: Bins open at once in a part.
OPEN_BINS = 2048
#: Pieces of a part that come longest first, about; after them the next ones do.
WAVE = 2500
#: Pieces that one part holds, about; a part with few pieces wastes its last bins.
PIECES_PER_PART = 50_000
#: Words remembered by each Python worker at most.
CACHE_WORDS = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_LETTERS, _POINTS = "a-zß-öø-ÿ", ".,!?*#%&$;:"
_UNIT = re.compile(rf"[{_LETTERS}]++(?=[{_POINTS} \n]|\Z)|[{_POINTS}]++(?=[{_LETTERS} \n]|\Z)|[^ \n]+")
_LETTER_UNIT = re.compile(rf"[{_LETTERS}]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: First bytes of characters from U+0300 on, where combining marks begin.
_MARK_BYTES = re.compile(rb"[\xcc-\xff]")


def units_of(text: str) -> list[str]:
    """Units that no token crosses and whose ids do not depend on their neighbours.

    They are the words between spaces and line feeds, cut once more between Latin letters and points.
    The tokenizer lower-cases, so ASCII letters are lower-cased here where the text has no combining
    mark: with marks, composition comes before.
    """
    raw = text.encode("utf-8", "surrogatepass")
    if not _MARK_BYTES.search(raw) or not any(map(unicodedata.combining, text)):
        text = raw.translate(_LOWER).decode("utf-8", "surrogatepass")
    return _UNIT.findall(text)


class WordTokens:
    """Token ids of texts by units. Units of Latin letters, which are most, merge in rounds by the
    tokenizer's own table of pairs; the library encodes all others."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        model = json.loads(self.tokenizer.to_str())["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merged = [a.removesuffix(suffix) + b if suffix else a + b for a, b in pairs]
        left, right, whole = (np.array([ids[x] for x in c], np.int64) for c in ([a for a, _ in pairs], [b for _, b in pairs], merged))
        self.pairs = PairTable(left, right, whole, np.arange(len(pairs)))
        # byte-level alphabets show the printable bytes as themselves and the others from U+0100 on
        shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
        hidden = [b for b in range(256) if b not in shown]
        letter = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}
        self.inner = np.array([ids[letter[b]] for b in range(256)])
        self.last = np.array([ids[letter[b] + suffix] for b in range(256)])

    def _merge(self, words: list[str]) -> None:
        spelled = [w.encode() for w in words]
        size = np.fromiter(map(len, spelled), np.int64, len(words))
        raw = np.frombuffer(b"".join(spelled), np.uint8)
        end = np.cumsum(size) - 1
        symbols = self.inner[raw]
        symbols[end] = self.last[raw[end]]
        joined = np.ones(len(raw) - 1, bool)
        joined[end[:-1]] = False
        tokens, position = self.pairs.merge(symbols, joined)
        flat = tokens.astype("<u4").tobytes()
        cuts = np.concatenate([[0], 4 * np.searchsorted(position, end, "right")]).tolist()
        self.known.update((w, flat[a:z]) for w, a, z in zip(words, cuts, cuts[1:], strict=False))

    def learn(self, words: set[str]) -> None:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        fresh = words.difference(self.known)
        letters = [w for w in fresh if _LETTER_UNIT.fullmatch(w)]
        if letters:
            self._merge(letters)
        others = list(fresh.difference(letters))
        for lo in range(0, len(others), 4096):
            some = others[lo : lo + 4096]
            for word, code in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[word] = np.array(code.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        for lo in range(0, len(texts), 256):
            split = [units_of(t or "") for t in texts[lo : lo + 256]]
            self.learn({w for words in split for w in words})
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of each row."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = word_tokens(tokenizer_path)
        end = int(SEPARATOR).to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc, ids in zip(batch["id"], tokens.encode(batch["text"].tolist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * sequence)):
                    part = ids[at : at + 4 * sequence]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(pieces, PIECES)


class OpenBins:
    """At most ``most`` open bins; a bit of ``free`` is set where a bin with that much free space is open."""

    def __init__(self, capacity: int = SEQUENCE, most: int = OPEN_BINS):
        self.capacity = capacity
        self.most = most
        self.free = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.made = 0

    def _take(self, space: int) -> int:
        found = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            at = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, at = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.bins[left].append(at)
            self.free |= 1 << left
            self.open += 1
        return at, self.capacity - space


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, per_part: int = PIECES_PER_PART) -> DataFrame:
    """The pieces with sequence_id and offset."""
    kept = cut(pieces)  # tokenised once: it is counted, then dealt
    count = kept.count()
    parts = max(1, -(-count // per_part))
    waves = max(1, round(count / parts / WAVE))
    placed = kept.withColumn("place", F.monotonically_increasing_id())  # of a cut table: the same whenever it is read
    dealt = placed.withColumns({"part": F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int"), "wave": F.pmod(F.xxhash64("place", F.lit(1)), F.lit(waves))}).drop("place")
    # ranges of part numbers, so that no two parts share a task by the luck of a hash
    dealt = dealt.repartitionByRange(parts, "part").sortWithinPartitions("part", "wave", F.col("length").desc(), "doc_id", "piece").drop("wave")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, current = OpenBins(sequence, open_bins), None
        for batch in batches:
            sequences, offsets = [], []
            for part, length in zip(batch["part"].tolist(), batch["length"].tolist(), strict=True):
                if part != current:
                    bins, current = OpenBins(sequence, open_bins), part
                at, offset = bins.place(length)
                sequences.append((part << 40) + at)
                offsets.append(offset)
            out = batch.drop(columns="part").assign(sequence_id=sequences, offset=offsets)
            yield out.astype({"doc_id": "Int64", "sequence_id": "int64", "offset": "int64"})

    return dealt.mapInPandas(pack, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence."""
    return pack_pieces(token_pieces(docs, tokenizer_path, id_col, text_col, sequence), sequence)
