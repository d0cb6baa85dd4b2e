"""Toxicity scores from a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their beginnings, so that inflected forms share
weights; each is present or absent. The machine adds to linear weights the pairwise products of
short factor vectors, so that a term can weigh differently next to another (an insult next to the
mention of a group). Hashed terms enter the model if their likelihood ratio on the labelled sample
is significant; the sample is bounded by ``LABELLED_ROWS`` (labels with the smallest id hashes), and
only its hashed terms come to the driver (about 4 KB of a text of average length). Scoring is an
independent map over all rows.

Defined results: null or empty text scores as a text without terms; a null id is never held out
and is not learned from; of labels that repeat an id the largest counts, of documents that repeat a
labelled id one is learned from; without labelled rows of both kinds the score is 0; an empty table
gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import remainder, whole_row

#: Bound on the labelled rows that the machine is fitted to.
LABELLED_ROWS = 12_000
HASH_BITS = 22
#: Likelihood ratio from which a term enters the model.
SIGNIFICANT = 15.0
#: Labelled documents that must hold a term; fewer cannot make it significant.
LEAST_DOCUMENTS = 3
FACTORS = 6
EPOCHS = 30
THRESHOLD = 0.3
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2
PREFIXES = (4, 5, 6)
#: Words remembered by each Python worker at most.
CACHE_WORDS = 400_000

_LETTERS = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[int]:
    """Hashed terms of one lower-cased word."""
    terms = [word] + [f"{word[:n]}~" for n in PREFIXES if len(word) > n]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1) for t in terms]


def text_words(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


class FactorizationMachine:
    """w0 + sum of w over present terms + sum of products of factor vectors over present pairs."""

    def __init__(self, terms: np.ndarray, factors: int = FACTORS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.terms = terms  # hash of each column
        self.bias = 0.0
        self.linear = np.zeros(len(terms) + 1)  # the last column pads
        self.factor = rng.normal(0, 0.02, (len(terms) + 1, factors))
        self.factor[-1] = 0

    def margin(self, columns: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows as runs of columns; starts has one more entry than there are rows."""
        rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        n = len(starts) - 1
        out = self.bias + np.bincount(rows, self.linear[columns], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[columns, f]
            out += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return out

    def fit(self, columns: np.ndarray, starts: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-5, factor_decay: float = 2e-3, batch: int = 256, seed: int = 5) -> None:
        """Adam over shuffled batches of rows."""
        rng = np.random.default_rng(seed)
        toxic, clean = labels.sum(), len(labels) - labels.sum()
        self.bias = float(np.log((toxic + 0.5) / (clean + 0.5)))
        # start from half of each term's own log odds: terms overlap
        owner = np.repeat(labels, np.diff(starts))
        with_toxic, with_clean = (np.bincount(columns, w, len(self.linear)) for w in (owner, 1 - owner))
        self.linear = 0.5 * np.log((with_toxic + 0.5) / (toxic + 1) * (clean + 1) / (with_clean + 0.5))
        self.linear[-1] = 0
        m1, v1 = np.zeros_like(self.linear), np.zeros_like(self.linear)
        m2, v2 = np.zeros_like(self.factor), np.zeros_like(self.factor)
        mb = vb = 0.0
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), batch):
                step += 1
                part = order[lo : lo + batch]
                sizes = starts[part + 1] - starts[part]
                rows = np.repeat(np.arange(len(part)), sizes)
                cols = columns[np.arange(sizes.sum()) + np.repeat(starts[part] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)]
                v = self.factor[cols]
                sums = np.zeros((len(part), v.shape[1]))
                np.add.at(sums, rows, v)
                squares = np.bincount(rows, (v * v).sum(1), len(part))
                margin = self.bias + np.bincount(rows, self.linear[cols], len(part)) + 0.5 * ((sums**2).sum(1) - squares)
                error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]
                g1 = np.bincount(cols, error[rows], len(self.linear)) / len(part) + decay * self.linear
                g2 = np.zeros_like(self.factor)
                np.add.at(g2, cols, error[rows, None] * (sums[rows] - v))
                g2 = g2 / len(part) + factor_decay * self.factor
                gb = float(error.mean())
                fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
                m1, v1 = 0.9 * m1 + 0.1 * g1, 0.999 * v1 + 0.001 * g1 * g1
                m2, v2 = 0.9 * m2 + 0.1 * g2, 0.999 * v2 + 0.001 * g2 * g2
                mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
                self.linear -= rate * (m1 / fix1) / (np.sqrt(v1 / fix2) + 1e-8)
                self.factor -= 0.4 * rate * (m2 / fix1) / (np.sqrt(v2 / fix2) + 1e-8)
                self.bias -= rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)


def significant_terms(documents: list[np.ndarray], labels: np.ndarray, least: float = SIGNIFICANT) -> np.ndarray:
    """Hashes whose presence depends on the label, by likelihood ratio; sorted."""
    with_pos, with_neg = np.zeros(1 << HASH_BITS, np.int32), np.zeros(1 << HASH_BITS, np.int32)
    for hashes, label in zip(documents, labels, strict=True):
        (with_pos if label else with_neg)[hashes] += 1  # a document holds a hash once
    seen_often = np.flatnonzero(with_pos + with_neg >= LEAST_DOCUMENTS)
    with_pos, with_neg = with_pos[seen_often].astype(float), with_neg[seen_often].astype(float)
    pos, neg = float(labels.sum()), float(len(labels) - labels.sum())

    def cell(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    share = (with_pos + with_neg) / (pos + neg)
    ratio = 2 * (cell(with_pos, pos * share) + cell(with_neg, neg * share) + cell(pos - with_pos, pos * (1 - share)) + cell(neg - with_neg, neg * (1 - share)))
    return seen_often[ratio >= least]


def hashed_terms(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct hashed terms of each text."""
    known: dict[str, list[int]] = {}
    documents = []
    for text in texts:
        hashes: set[int] = set()
        for word in text_words(text):
            if (terms := known.get(word)) is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                terms = known[word] = word_terms(word)
            hashes.update(terms)
        documents.append(np.fromiter(hashes, np.int32, len(hashes)))
    return documents


def train(documents: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine | None:
    """A machine fitted to the hashed terms of labelled texts; None where a kind of label is missing."""
    if not len(labels) or labels.min() == labels.max():
        return None
    terms = significant_terms(documents, labels)
    rows = []
    for hashes in documents:
        at = np.searchsorted(terms, hashes)
        hit = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == hashes) if len(terms) else np.zeros(len(hashes), bool)
        rows.append(np.sort(at[hit]))
    machine = FactorizationMachine(terms)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    machine.fit(np.concatenate(rows).astype(np.int64), starts, labels.astype(float))
    return machine


class Scorer:
    """Scores texts; remembers which words have terms in the model."""

    def __init__(self, machine: FactorizationMachine):
        self.machine = machine
        self.column = {int(h): i for i, h in enumerate(machine.terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def columns(self, text: str | None) -> list[int]:
        found: set[int] = set()
        known, column = self.known, self.column
        for word in text_words(text):
            if (cols := known.get(word)) is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                cols = known[word] = tuple(column[h] for h in word_terms(word) if h in column)
            if cols:
                found.update(cols)
        return sorted(found)

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows = [self.columns(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        flat = np.fromiter((c for r in rows for c in r), np.int64, int(starts[-1]))
        return 1 / (1 + np.exp(-np.clip(self.machine.margin(flat, starts), -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bound: int) -> DataFrame:
    """Hashed terms and label of at most ``bound`` labelled ids outside the held-out part, one row of each."""
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    chosen = (
        marks.where(remainder(F.col("id"), HELD_OUT_MODULUS) != HELD_OUT_REMAINDER)
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(bound)
    )

    @F.pandas_udf("binary")
    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series([np.sort(h).tobytes() for h in hashed_terms(texts.tolist())])

    found = docs.join(F.broadcast(chosen), "id").select("id", "label", terms("text").alias("terms"))
    return found.groupBy("id", "label").agg(F.min("terms").alias("terms"))


def score_column(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled_rows: int = LABELLED_ROWS) -> Column:
    """Learns from the labelled rows; the score of each row's text as a column of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = labelled_sample(rows, labels, label_col, labelled_rows)
    learned = sorted((r["id"], r["terms"], r["label"]) for r in sample.toLocalIterator())  # labelled_rows rows at most
    machine = train([np.frombuffer(t, np.int32) for _, t, _ in learned], np.asarray([y for _, _, y in learned], np.int64))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(machine) if machine is not None else None
        for texts in batches:
            yield pd.Series(scorer.score(texts.tolist()) if scorer else np.zeros(len(texts)))

    return score(F.col(text_col))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted; one row per input row. Options as for ``score_column``."""
    doc_id = F.col(id_col).cast("long").alias("doc_id")
    scored = docs.select(doc_id, score_column(docs, labels, id_col, text_col, **options).alias("score"))
    held_out = F.coalesce(remainder(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT_REMAINDER, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows below the threshold, with all their columns; each is judged by its own text."""
    scored = docs.select(whole_row(docs), score_column(docs, labels, id_col, text_col).alias("score"))
    return scored.where(F.col("score") < THRESHOLD).select("row.*")
