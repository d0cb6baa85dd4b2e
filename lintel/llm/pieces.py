"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many units of text lie in one flat array and merge in rounds. The result is what the
library gives: only pieces that begin with the space mark hold one, so a text falls into independent
units: a run of marks with what follows, and line feeds, which no piece holds. Within a unit,
neighbours that stand side by side in no piece are cut apart as well.

Units recur, so each Python worker remembers the units it has met, up to ``CACHE_UNITS``.

Defined results: null or empty text has no ids and decodes to the empty string; a null id is kept;
a text of any length is encoded whole; an empty table gives an empty result; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.merge_rounds import PairTable

MARK = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
CACHE_UNITS = 500_000
#: Texts whose unknown units are encoded together.
TEXTS_AT_ONCE = 256
#: Texts that common normalisers change: compatibility forms, combining marks, runs of space, capitals.
PROBES = ("ﬁ Ａ① x", "e\u0301 é", "  two  spaces  ", "\tTab\u3000wide\u00a0x", "ABC Straße")


class PieceModel:
    """Vocabulary, pair table and merge rounds of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.size = size
        self.text = [sp.id_to_piece(i) for i in range(size)]
        special = np.array([sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)])
        self.byte_id = np.zeros(256, np.int64)
        self.byte_of = {}
        for i in range(size):
            if sp.is_byte(i):
                value = int(self.text[i][3:-1], 16)
                self.byte_id[value] = i
                self.byte_of[i] = value
        self.hidden = frozenset(i for i in range(size) if sp.is_control(i))
        self.number = [str(i) for i in range(size)]
        #: Text of each piece; None for those that stand for bytes or nothing.
        self.plain = [None if special[i] else t.replace(MARK, " ") for i, t in enumerate(self.text)]
        symbol = {self.text[i]: i for i in range(size) if not special[i]}
        long_pieces = [p for p in symbol if len(p) > 1]
        for c in sorted({c for p in long_pieces for c in p} - set(symbol)):
            symbol[c] = len(self.text) + len(symbol)  # merges like a piece, but goes out as bytes
        scores = np.array([sp.get_score(i) for i in range(size)])
        _, rank_of = np.unique(-scores, return_inverse=True)
        pairs = [(symbol[p[:k]], symbol[p[k:]], symbol[p]) for p in long_pieces for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        left, right, merged = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self.pairs = PairTable(left, right, merged, rank_of[merged])
        beside = {pair for p in long_pieces for pair in zip(p, p[1:], strict=False)}

        chars = sorted(c for c in symbol if len(c) == 1)
        self.char_codes = np.array([ord(c) for c in chars] + [0x110000], np.int64)
        self.char_symbols = np.array([symbol[c] for c in chars] + [-1], np.int64)
        self.beside = np.sort(np.array([ord(a) * 0x110000 + ord(b) for a, b in beside] + [2**62], np.int64))
        inner = [p for p in long_pieces if MARK in p.lstrip(MARK)]
        if inner or any("\n" in p for p in symbol):
            raise ValueError("pieces with inner space marks or line feeds are not supported")
        self.block = self._mark_block(long_pieces)
        self.known: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        marks = f"{MARK}{{{self.block}}}(?={MARK})|" if self.block else ""
        points = "".join(map(re.escape, self._cut_points(beside)))
        rest = f"[^{MARK}\n]+"
        if points:
            end = f"{MARK}\n]|\\Z"
            rest = f"[{LATIN}]++(?=[{points}{end})|[{points}]++(?=[{LATIN}{end})|{rest}"
        self.unit = re.compile(f"\n|{marks}{MARK}*(?:{rest})|{MARK}+")
        for probe in PROBES:
            if self.encode(probe) != sp.encode(probe):
                raise ValueError("the model changes text before it encodes it, which is not supported")

    @staticmethod
    def _cut_points(beside: set[tuple[str, str]]) -> list[str]:
        """Punctuation that stands next to a Latin letter in no piece: units are cut between the two."""
        letter = re.compile(f"[{LATIN}]")
        mixed = {c for pair in beside if letter.match(pair[0]) or letter.match(pair[1]) for c in pair}
        return sorted(set(string.punctuation) - mixed)

    def _mark_block(self, long_pieces: list[str]) -> int:
        """Length of the longest piece of marks, if long runs of marks fall into such pieces from the left."""
        longest = max((len(p) for p in long_pieces if not p.strip(MARK)), default=0)
        self.block = 0
        probe = self.encode_units([MARK * (3 * longest + k) for k in range(longest)]) if longest else []
        same = all([self.text[i] for i in ids[:3]] == [MARK * longest] * 3 for ids in probe)
        return longest if same else 0

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit; units hold no space mark after another character."""
        flat, ends = self.encode_flat(units)
        return np.split(flat, ends[:-1])

    def encode_flat(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and where each unit ends."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(units), np.int64)
        at = np.searchsorted(self.char_codes, codes)
        symbols = np.where(self.char_codes[at] == codes, self.char_symbols[at], -1 - codes)  # below 0: a character outside the vocabulary
        owner = np.repeat(np.arange(len(units)), sizes)
        pair = codes[:-1] * 0x110000 + codes[1:]
        joined = self.beside[np.searchsorted(self.beside, pair)] == pair
        joined &= owner[1:] == owner[:-1]
        symbols, position = self.pairs.merge(symbols, joined)
        return self._ids(symbols, owner[position], len(units), codes[position])

    def _ids(self, symbols: np.ndarray, owner: np.ndarray, n: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and unit ends; characters outside the vocabulary become their UTF-8 bytes."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if len(odd):
            spelled = {int(c): self.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))] for c in np.unique(codes[odd])}
            width = np.ones(len(symbols), np.int64)
            width[odd] = [len(spelled[int(c)]) for c in codes[odd]]
            out = np.repeat(symbols, width)
            begin = np.cumsum(width) - width
            for i in odd:
                out[begin[i] : begin[i] + width[i]] = spelled[int(codes[i])]
            symbols, owner = out, np.repeat(owner, width)
        return symbols, np.cumsum(np.bincount(owner, minlength=n))

    def units(self, text: str | None) -> list[str]:
        """The independent units of a text, the mark of the dummy prefix included."""
        return self.unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, units: Iterable[str]) -> None:
        """Encode the units that are not remembered yet."""
        if len(self.known) >= CACHE_UNITS:
            self.known.clear()
            self.decoded.clear()
        fresh = list(set(units).difference(self.known))
        flat, ends = self.encode_flat(fresh)
        flat, ends = flat.tolist(), ends.tolist()
        numbers = list(map(self.number.__getitem__, flat))
        words = list(map(self.plain.__getitem__, flat))
        lo = 0
        for unit, hi in zip(fresh, ends, strict=True):
            self.known[unit] = ",".join(numbers[lo:hi])
            try:
                self.decoded[unit] = "".join(words[lo:hi])
            except TypeError:  # byte pieces
                self.decoded[unit] = self.spell(flat[lo:hi])
            lo = hi

    def spell(self, ids: Iterable[int]) -> str:
        """Text of ids, space marks as spaces; runs of byte pieces are UTF-8."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.hidden:
                out.append(self.text[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str | None) -> list[int]:
        units = self.units(text)
        self.learn(units)
        return [int(i) for u in units for i in self.known[u].split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        text = self.spell(ids)
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each text."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(model_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["id"].astype("Int64"), "ids": [model.encode(t) for t in batch["text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each array of ids."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(model_path)
        for batch in batches:
            texts = [model.decode(ids) if ids is not None else "" for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["id"].astype("Int64"), "text": texts})

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInPandas(decode, "doc_id long, text string")


def encoded_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by commas) and of the text they decode to."""
    import hashlib

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(model_path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for lo in range(0, len(batch), TEXTS_AT_ONCE):
                some = [model.units(t) for t in batch["text"].iloc[lo : lo + TEXTS_AT_ONCE]]
                model.learn(u for units in some for u in units)
                for units in some:
                    ids = ",".join(map(model.known.__getitem__, units))
                    text = "".join(map(model.decoded.__getitem__, units))
                    counts.append(ids.count(",") + bool(ids))
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256((text[1:] if text.startswith(" ") else text).encode("utf-8", "surrogatepass")).hexdigest())
            yield pd.DataFrame({"doc_id": batch["id"].astype("Int64"), "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
