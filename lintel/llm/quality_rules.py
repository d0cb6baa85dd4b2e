"""Quality rules judged by an isolation forest.

Each text yields rule statistics (counts of words, symbols, repeated lines and repeated windows) and
rates from them. Trees of random splits over the rates, in whose nodes all labelled rows that were
accepted are counted, give every row an expected path length: rows that few splits isolate are anomalous.
Cuts are drawn over the range that all labelled rows span, so that a split can also part off what no
accepted row shows; they hang on nothing else, so trees are drawn first and rows counted where they lie.
The score is told to ``PLACES`` decimals, and the threshold on it is calibrated on the counts of all
labelled rows of both kinds at each score. Statistics are computed once for every row and cut to the
shared folder; labelled rows and scoring both read them from there.

Nothing is sampled: the driver holds the trees and a count for each leaf and for each score.

Defined results: null or empty text has no words, fails the base rules and is not kept; a null id
is scored like any other; of labels that repeat an id the largest counts, of documents that repeat a
labelled id one is learned from; without labelled rows of both kinds only the base rules reject; an
empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import WORD_SEPARATORS, cut, whole_row, words_of, written

TREES = 128
#: Trees are as deep as one over so many rows has to be.
ROWS_PER_TREE = 1024
#: Decimals of the score.
PLACES = 5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Of accepted labelled rows, the share that the threshold may reject at most.
MAX_FALSE_REJECTS = 0.01

SYMBOLS = "#*$%&|<>"
FEATURES = ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "shout_rate", "digit_rate")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join([*[f"{c} long" for c in COUNTS], *[f"{f} double" for f in FEATURES]])

_SYMBOL_BYTES = np.frombuffer(SYMBOLS.encode(), np.uint8)


def _repeat_words(words: list[str]) -> int:
    """Positions covered by 3-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    number = {w: i for i, w in enumerate(set(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) ** 3 < 2**63:
        windows = pairs[:-1] * len(number) + ids[2:]
    else:
        _, ranked = np.unique(pairs[:-1], return_inverse=True)
        windows = ranked * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    repeated = np.zeros(len(windows) + 2, bool)
    at = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        repeated[at + k] = True
    return int(repeated.sum())


def text_statistics(text: str | None) -> tuple[float, ...]:
    """The five counts of the contract, then FEATURES."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    seen: set[str] = set()
    lines = dup_lines = 0
    for line in text.split("\n"):
        if line.strip(WORD_SEPARATORS):
            lines += 1
            if line in seen:
                dup_lines += 1
            seen.add(line)
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    symbols = int(count[_SYMBOL_BYTES].sum())
    upper, digits = int(count[65:91].sum()), int(count[48:58].sum())
    letters = upper + int(count[97:123].sum())
    repeat = _repeat_words(words)
    return (
        n,
        sum(map(len, words)),
        symbols,
        dup_lines,
        repeat,
        symbols / max(n, 1),
        dup_lines / max(lines, 1),
        repeat / max(n, 1),
        upper / max(letters, 1),
        int(count[33]) / max(n, 1),
        digits / max(len(text), 1),
    )


def statistics_column(text: Column) -> Column:
    """Counts and rates of each text as one struct."""

    @F.pandas_udf(SCHEMA)
    def compute(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_statistics(t) for t in texts], columns=[*COUNTS, *FEATURES])

    return compute(text)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    big = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


def log_rates(rates: np.ndarray) -> np.ndarray:
    """Rates on a scale on which a thousandth and a tenth are some steps apart; zero stays zero."""
    return np.log1p(1000.0 * rates)


class IsolationForest:
    """Trees of random splits, each in arrays: split feature (-1: leaf), cut, left child, path length.

    A cut is drawn from the whole range that a node's box has of ``low`` to ``high``, whether or not
    rows lie there. All rows are counted in every tree; ``sample`` bounds the depth, as that of a tree over so many.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int = ROWS_PER_TREE, seed: int = 7):
        self._draw(len(rows), low, high, trees, sample, seed)
        self._settle(self.counts(rows))

    @classmethod
    def of_table(cls, rows: DataFrame, n: int, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int = ROWS_PER_TREE, seed: int = 7) -> IsolationForest:
        """The forest over the n rows of a table of rates (FEATURES), counted in its partitions."""
        forest = cls.__new__(cls)
        forest._draw(n, low, high, trees, sample, seed)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = 0
            for batch in batches:
                total = total + forest.counts(log_rates(batch[list(FEATURES)].to_numpy(float)))
            if not np.isscalar(total):
                tree, node = np.nonzero(total)
                yield pd.DataFrame({"tree": tree, "node": node, "n": total[tree, node]})

        found = rows.mapInPandas(count, "tree long, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((trees, 2 ** (forest.depth + 1) - 1), np.int64)
        counts[found["tree"].to_numpy(int), found["node"].to_numpy(int)] = found["n"]
        forest._settle(counts)
        return forest

    def _draw(self, n: int, low: np.ndarray, high: np.ndarray, trees: int, sample: int, seed: int) -> None:
        """Splits of whole trees, before any row is counted; the children of node i are 2i + 1 and 2i + 2."""
        rng = np.random.default_rng(seed)
        self.rows = n
        self.depth = max(1, int(np.ceil(np.log2(max(min(sample, n), 2)))))
        self.trees = []
        for _ in range(trees):
            feature = np.full(2 ** (self.depth + 1) - 1, -1, np.int8)
            cuts = np.zeros(len(feature))
            lows, highs = np.asarray(low, float)[None], np.asarray(high, float)[None]
            for level in range(self.depth):
                width = np.arange(2**level)
                open_features = highs > lows
                f = np.argmax(np.where(open_features, rng.random(lows.shape), -1.0), 1)
                at = lows[width, f] + rng.random(len(width)) * (highs[width, f] - lows[width, f])
                feature[width + len(width) - 1] = np.where(open_features.any(1), f, -1)
                cuts[width + len(width) - 1] = at
                lows, highs = np.repeat(lows, 2, 0), np.repeat(highs, 2, 0)
                highs[2 * width, f] = lows[2 * width + 1, f] = at
            self.trees.append((feature, cuts, 2 * np.arange(len(feature), dtype=np.int32) + 1, np.zeros(len(feature))))

    def _ends(self, rows: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
        """The leaf in which each row ends."""
        feature, cuts, left, _ = tree
        at = np.zeros(len(rows), np.int64)
        for _ in range(self.depth + 1):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = rows[np.arange(len(rows)), np.maximum(f, 0)] >= cuts[at]
            at = np.where(inner, left[at] + right, at)
        return at

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Rows that end in each node of each tree."""
        return np.stack([np.bincount(self._ends(rows, tree), minlength=len(tree[0])) for tree in self.trees])

    def _settle(self, counts: np.ndarray) -> None:
        """Nodes with one row at most end a path; a leaf's path is its depth and what a random tree over its rows takes."""
        upto = counts.copy()
        depths = np.log2(np.arange(counts.shape[1]) + 1).astype(int)
        for node in range(counts.shape[1] - 1, 0, -1):
            upto[:, (node - 1) // 2] += upto[:, node]
        for (feature, _, _, path), n in zip(self.trees, upto, strict=True):
            feature[n <= 1] = -1
            path[:] = np.where(feature < 0, depths + average_path(n), 0.0)

    def path_lengths(self, rows: np.ndarray) -> np.ndarray:
        """Mean over the trees of the splits until a row is alone, with the expected rest of a larger leaf."""
        total = np.zeros(len(rows))
        for tree in self.trees:
            total += tree[3][self._ends(rows, tree)]
        return total / max(len(self.trees), 1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score, 0 to 1."""
        return np.round(2.0 ** (-self.path_lengths(rows) / max(float(average_path(self.rows)), 1e-9)), PLACES)


def calibrate(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, max_false_rejects: float = MAX_FALSE_REJECTS) -> float:
    """The threshold with the best balance of recall and false rejects within the allowed share of those, from the numbers of
    accepted and rejected rows at each score, which ascend."""
    below_good, below_bad = np.cumsum(good)[:-1] / good.sum(), np.cumsum(bad)[:-1] / bad.sum()
    false = 1 - below_good
    gain = np.where(false <= max_false_rejects, (1 - below_bad) - 3 * false, 0.0)
    if not len(gain) or gain.max() <= 0:
        return np.inf
    k = int(gain.argmax())
    return float(scores[k] + scores[k + 1]) / 2


def anomaly_column(forest: IsolationForest) -> Callable[[str], Column]:
    @F.pandas_udf("double")
    def anomaly(stats: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.score(log_rates(stats[list(FEATURES)].to_numpy(float))))

    return anomaly


def fit(seen: DataFrame) -> tuple[IsolationForest, float] | None:
    """Forest and threshold from all labelled rows (accepted, stats); None where a kind of label is missing."""
    rates = [F.col(f"stats.{f}") for f in FEATURES]
    span = seen.agg(F.count_if("accepted").alias("good"), F.count(F.lit(1)).alias("n"), F.array(*map(F.min, rates)).alias("low"), F.array(*map(F.max, rates)).alias("high")).first()
    if span["good"] in (0, span["n"]):
        return None
    low, high = (log_rates(np.array(span[k], float)) for k in ("low", "high"))
    forest = IsolationForest.of_table(seen.where("accepted").select("stats.*"), span["good"], low, high)
    # as many rows as scores have values, however many labels there are
    told = seen.select("accepted", anomaly_column(forest)("stats").alias("score")).groupBy("score")
    told = told.agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad")).orderBy("score").toPandas()
    return forest, calibrate(*(told[c].to_numpy(float) for c in ("score", "good", "bad")))


def judged(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "quality",
    *carried: Column,
) -> DataFrame:
    """doc_id, stats (counts and rates), base_failed, anomaly and kept of each input row, and the carried columns."""
    found = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), statistics_column(F.col(text_col)).alias("stats"), *carried))
    n, repeated = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    found = found.withColumn("base_failed", (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n))
    marks = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).dropna()
    chosen = marks.groupBy("doc_id").agg((F.max("label") == 1).alias("accepted"))
    seen = found.where(~F.col("base_failed")).select("doc_id", "stats").join(chosen, "doc_id").groupBy("doc_id", "accepted").agg(F.min("stats").alias("stats"))
    model = fit(written(seen))
    anomaly = anomaly_column(model[0])("stats") if model else F.lit(0.0)
    usual = (F.col("anomaly") < model[1]) if model else F.lit(True)
    return found.withColumn("anomaly", anomaly).withColumn("kept", ~F.col("base_failed") & usual)


def judge_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the counts, base_failed, kept, anomaly and the rates; one row per input row. Options as for ``judged``."""
    return judged(docs, labels, **options).select(
        "doc_id", *[f"stats.{c}" for c in COUNTS], "base_failed", "kept", "anomaly", *[f"stats.{f}" for f in FEATURES]
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns; each is judged by its own text."""
    return judged(docs, labels, id_col, text_col, "doc_id", "quality", whole_row(docs)).where("kept").select("row.*")
