"""Language identification by a byte convolutional network.

A text is its UTF-8 bytes, cut into windows of ``WINDOW`` bytes that cover it whole. Each byte has
a short vector; filters of several widths run over a window, the maximum of each over the window
feeds a softmax over the languages met in training. A text's probabilities are the geometric mean
of its windows'. Training takes all windows of a bounded sample of labelled texts (the smallest id
hashes, at most ``LABELLED_ROWS`` rows, ``ROWS_PER_LANGUAGE`` of a language); of documents that repeat an
id one is learned from. Prediction is an independent map over all rows.

Defined results: a text that is null or has no letter is ``und`` with score 0; a null id is never
held out and not learned from; rows without a language are not learned from; without learned
languages all rows are ``und``; an empty table gives an empty result; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import remainder

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
VECTOR = 8
#: Bounds on the labelled rows that the network learns from.
LABELLED_ROWS = 2_048
ROWS_PER_LANGUAGE = 512
SALTS = 64
EPOCHS = 6
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2
#: Windows that run through the filters together.
WINDOWS_AT_ONCE = 64

_LETTER = re.compile(r"[^\W\d_]")
#: Byte 256 fills the last window of a text.
PAD = 256


def windows_of(text: str) -> np.ndarray:
    """The bytes of a text in rows of WINDOW; a remainder shorter than half a row fills up with earlier bytes where there are any."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    whole, rest = divmod(len(raw), WINDOW)
    out = np.full((whole + bool(rest), WINDOW), PAD, np.int64)
    out[:whole] = raw[: whole * WINDOW].reshape(whole, WINDOW)
    if rest and whole:
        out[whole] = raw[-WINDOW:]
    elif rest:
        out[whole, :rest] = raw
    return out


class ByteConvolution:
    """Byte vectors, filters of several widths, maximum over the window, softmax."""

    def __init__(self, languages: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self._tables: dict[int, list[np.ndarray]] | None = None
        hidden = FILTERS * len(WIDTHS)
        self.weights = {"vector": rng.normal(0, 0.5, (257, VECTOR)).astype(np.float32)}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = rng.normal(0, 1 / np.sqrt(w * VECTOR), (w * VECTOR, FILTERS)).astype(np.float32)
            self.weights[f"shift{w}"] = np.zeros(FILTERS, np.float32)
        self.weights["out"] = rng.normal(0, 0.1, (hidden, len(languages))).astype(np.float32)
        self.weights["bias"] = np.zeros(len(languages), np.float32)
        self.weights["vector"][PAD] = 0

    def _grams(self, rows: np.ndarray, width: int) -> np.ndarray:
        vectors = self.weights["vector"][rows]
        n, length, _ = vectors.shape
        return np.lib.stride_tricks.sliding_window_view(vectors.reshape(n, length * VECTOR), width * VECTOR, axis=1)[:, ::VECTOR]

    def features(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled filters of each window, and where each maximum lies."""
        pooled, at = [], []
        for w in WIDTHS:
            grams = self._grams(rows, w)
            n, steps, size = grams.shape
            values = (grams.reshape(n * steps, size) @ self.weights[f"filter{w}"]).reshape(n, steps, FILTERS)
            pooled.append(values.max(1) + self.weights[f"shift{w}"])
            at.append(values.argmax(1))
        return np.maximum(np.concatenate(pooled, 1), 0), at

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width what pairs of bytes (and a last single byte) add to its filters."""
        if self._tables is None:
            self._tables = {}
            for w in WIDTHS:
                taps = self.weights[f"filter{w}"].reshape(w, VECTOR, FILTERS)
                single = [self.weights["vector"] @ tap for tap in taps]
                pairs = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(-1, FILTERS) for j in range(0, w - 1, 2)]
                self._tables[w] = pairs + ([single[-1]] if w % 2 else [])
        return self._tables

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        """By table look-up: a filter's value is a sum over the bytes below it."""
        place = np.ascontiguousarray(rows.T)
        pair = place[:-1] * 257 + place[1:]
        n = len(rows)
        pooled = []
        for w, parts in self.tables().items():
            steps = WINDOW - w + 1
            values = np.zeros((steps, n, FILTERS), np.float32)
            for j, part in enumerate(parts):
                index = place if len(part) == 257 else pair
                values += part.take(index[2 * j : 2 * j + steps], axis=0)
            pooled.append(values.reshape(steps, n * FILTERS).max(0).reshape(n, FILTERS) + self.weights[f"shift{w}"])
        logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.weights["out"] + self.weights["bias"]
        logits = logits - logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))

    def gradients(self, rows: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Mean gradients of the cross entropy."""
        n = len(rows)
        hidden, places = self.features(rows)
        logits = hidden @ self.weights["out"] + self.weights["bias"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), truth] -= 1
        p /= n
        out = {"out": hidden.T @ p, "bias": p.sum(0), "vector": np.zeros_like(self.weights["vector"])}
        back = (p @ self.weights["out"].T) * (hidden > 0)
        for k, w in enumerate(WIDTHS):
            error = back[:, k * FILTERS : (k + 1) * FILTERS]
            out[f"shift{w}"] = error.sum(0)
            at = places[k][:, :, None] + np.arange(w)
            bytes_at = rows[np.arange(n)[:, None, None], at]  # window, filter, place in the filter
            grams = self.weights["vector"][bytes_at].reshape(n, FILTERS, w * VECTOR)
            out[f"filter{w}"] = np.einsum("nf,nfs->sf", error, grams)
            into = error[:, :, None] * self.weights[f"filter{w}"].T[None]
            np.add.at(out["vector"], bytes_at.reshape(-1), into.reshape(-1, VECTOR))
        out["vector"][PAD] = 0
        return out

    def fit(self, rows: np.ndarray, truth: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 2) -> None:
        """Adam over shuffled batches of windows."""
        rng = np.random.default_rng(seed)
        self._tables = None
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                step += 1
                part = order[lo : lo + batch]
                for k, g in self.gradients(rows[part], truth[part]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] -= np.float32(rate / (1 + epoch)) * move.astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        waiting: list[np.ndarray] = []
        owners: list[int] = []
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))

        def run() -> None:
            rows = np.concatenate(waiting)
            owner = np.repeat(owners, [len(w) for w in waiting])
            for lo in range(0, len(rows), WINDOWS_AT_ONCE):
                logs = self.log_probabilities(rows[lo : lo + WINDOWS_AT_ONCE])
                np.add.at(total, owner[lo : lo + WINDOWS_AT_ONCE], logs)
            np.add.at(count, owner, 1)
            waiting.clear()
            owners.clear()

        for i, text in enumerate(texts):
            if text and _LETTER.search(text):
                waiting.append(windows_of(text))
                owners.append(i)
                if sum(map(len, waiting)) >= 16 * WINDOWS_AT_ONCE:
                    run()
        if waiting:
            run()
        for i in np.flatnonzero(count):
            mean = total[i] / count[i]
            p = np.exp(mean - mean.max())
            p /= p.sum()
            best = int(p.argmax())
            names[i], scores[i] = self.languages[best], float(p[best])
        return names, scores


def train(texts: list[str], languages: list[str]) -> ByteConvolution | None:
    """A network fitted to labelled texts; None without any."""
    names = sorted(set(languages))
    if not names:
        return None
    rows = [windows_of(text) for text in texts]
    truth = np.repeat([names.index(language) for language in languages], [len(r) for r in rows])
    network = ByteConvolution(names)
    network.fit(np.concatenate(rows), truth)
    return network


def identify_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    labelled_rows: int = LABELLED_ROWS,
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> DataFrame:
    """doc_id, held_out, lang_pred and score; one row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learnable = rows.where(
        F.col("lang").isNotNull() & (remainder(F.col("id"), HELD_OUT_MODULUS) != HELD_OUT_REMAINDER) & F.col("text").rlike(r"\p{L}")
    )
    # of each language the first rows of each of SALTS hash classes, so that no task ranks a whole language
    salt = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(SALTS))
    hashed = learnable.select("id", "lang", F.xxhash64("id").alias("h"), salt.alias("salt"))
    rank = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "id"))
    first = hashed.withColumn("n", rank).where(F.col("n") <= max(1, rows_per_language // SALTS))
    chosen = first.orderBy("n", "salt", "lang").limit(labelled_rows).select("id", F.col("lang").alias("language"))

    drawn = rows.join(F.broadcast(chosen), "id").where("lang = language").groupBy("id", "language").agg(F.min("text").alias("text"))
    learned = sorted((r["id"], r["text"], r["language"]) for r in drawn.toLocalIterator())  # labelled_rows rows at most
    network = train([text for _, text, _ in learned], [language for _, _, language in learned])

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = network.predict(texts.tolist()) if network else (["und"] * len(texts), np.zeros(len(texts)))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    held_out = F.coalesce(remainder(F.col("id"), HELD_OUT_MODULUS) == HELD_OUT_REMAINDER, F.lit(False))
    return rows.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), predict("text").alias("found")).select("doc_id", "held_out", "found.*")
