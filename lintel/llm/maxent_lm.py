"""Language-model scores from a hashed maximum-entropy model.

A token's probability is that of its class given the two tokens before it, times its own within the
class. Classes, and words within a head class, are softmaxes over ``width`` outcomes whose logits are
sums of rows of one hashed weight matrix: for the class, a bias and features of the previous token, of
the token before it (a skip) and of both (an n-gram); within a class, a bias and a feature of the
previous token. Frequent words fill the head classes, ``width`` words each; all other words, also
unseen ones, belong to tail classes by their ending. Within a tail class a word has its smoothed
relative frequency, and every pair of words that the corpus holds twice or more has a feature of its
own: its weight meets the discounted count of the pair, the others share what it leaves.

What is gathered covers every training text and grows with the corpus: exact word counts, pairs of
words, and how often each class or head word follows each pair of histories. ``width``, and with it
histories, classes, head words and features, grows with the number of training tokens (``Sizes``).
Word counts and pair features stay partitioned tables: scoring asks them by a join on hashed keys, of
which frequent ones may be dealt anew by adaptive execution. The weight matrix is trained by
gradients over parts of the table of what follows what. A part holds the softmaxes whose n-gram features
fall into its share of the matrix, and with them those rows and their moments, which are updated where
their gradient is summed; the few features that parts have in common are summed in a tree and updated
on the driver. The trained matrix goes to the scoring tasks in half precision; its size grows with the
cube root of the corpus. A run that fails leaves its last table of parts in the checkpoint folder. Only the ``FREQUENT`` most frequent words go to the workers as numbers.

Defined results: null or empty text has the end token alone; a null id is not held out and is
learned from; rows that repeat get the same scores each; an empty table gives an empty result;
without training rows all words are unseen; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import LOWER_BYTES, remainder, remove_written, written

HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 5, 1
#: The end token; no word holds a separator.
END = b"\n"
UPDATES = 14
#: Words at most that every worker holds as numbers; all others meet their counts in a join.
FREQUENT = 250_000
#: Words that a counting task holds before it hands them on.
HELD_WORDS = 500_000
TEXTS_AT_ONCE = 200
#: Tokens whose cells are counted together.
CELLS_AT_ONCE = 1 << 21
#: Bytes of a word that tell its ending.
ENDING_BYTES = 3
#: Taken from the count of a pair of words that recurs.
DISCOUNT = 0.75
#: Floats of the rows of probabilities that a scoring task keeps.
KEPT_FLOATS = 1 << 24
#: Softmaxes in a part of the table of what follows what, and rows of the matrix that are updated together.
PART_ROWS, UPDATE_ROWS = 8192, 2048
#: Gradients of common features that one step of the tree, or the driver, sums.
FAN = 8
#: A part's row while the model is trained; rows of a negative part hold a task's gradient of the common rows.
STATE = "part long, rows binary, counts binary, weights binary, moments binary, gradient binary"


@dataclass(frozen=True)
class Sizes:
    """How large the model is, by one number; and in how many parts it is trained."""

    width: int
    part_rows: int = PART_ROWS

    @staticmethod
    def of(tokens: int) -> Sizes:
        """A power of two near six times the sixth root of the training tokens."""
        return Sizes(2 ** max(3, round(math.log2(max(tokens, 1)) / 6 + 2.6)))

    @property
    def own(self) -> int:
        """Histories of their own: the most frequent words; others share a history by their ending."""
        return self.width

    @property
    def shared(self) -> int:
        return self.width // 2

    @property
    def buckets(self) -> int:
        return self.own + self.shared

    @property
    def tail_classes(self) -> int:
        return self.width // 4

    @property
    def head_classes(self) -> int:
        return self.width - self.tail_classes

    @property
    def endings(self) -> int:
        return self.shared * self.tail_classes

    @property
    def pairs(self) -> int:
        return self.buckets**2

    @property
    def rows(self) -> int:
        """Softmaxes: one over classes for each pair of histories, one over words for each history and head class."""
        return self.pairs + self.buckets * self.head_classes

    @property
    def features(self) -> int:
        """Rows of the weight matrix; one more, of zeros, fills up."""
        return 128 * self.width

    @property
    def common(self) -> int:
        """Of these, the first hold biases and features of one history, which many softmaxes share."""
        return 8 * self.width

    @property
    def parts(self) -> int:
        return math.ceil(self.rows / self.part_rows)

    def part_of(self, feature: np.ndarray) -> np.ndarray:
        """The part of a feature that few softmaxes share."""
        return (feature - self.common) * self.parts // (self.features - self.common)

    def features_of(self, part: int) -> tuple[int, int]:
        """The features of a part: from the first on, up to but without the second."""
        span = self.features - self.common
        low, high = (self.common - (-p * span // self.parts) for p in (part, part + 1))
        return low, high


def tokens_of(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()  # at the six separators
    words.append(END)
    return words


def mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def word_hash(word: bytes) -> int:
    """As F.xxhash64 of the word gives it, unsigned."""
    import xxhash

    return xxhash.xxh64_intdigest(word, 42)


def row_features(rows: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Hashed feature numbers of softmaxes (of pairs of histories, then of history and class); the last is its n-gram's."""

    def hashed(kind: int, value: np.ndarray, low: int, high: int) -> np.ndarray:
        number = mixed(value.astype(np.uint64) + np.uint64(kind << 40))
        return low + (number % np.uint64(high - low)).astype(np.int64)

    out = np.full((len(rows), 4), sizes.features, np.int64)
    is_pair = rows < sizes.pairs
    pair, cell = rows[is_pair], rows[~is_pair] - sizes.pairs
    for column, value in enumerate((0 * pair, pair // sizes.buckets, pair % sizes.buckets)):
        out[is_pair, column] = hashed(column, value, 0, sizes.common)
    out[is_pair, 3] = hashed(3, pair, sizes.common, sizes.features)
    out[~is_pair, 0] = hashed(4, cell % sizes.head_classes, 0, sizes.common)
    out[~is_pair, 3] = hashed(5, cell, sizes.common, sizes.features)
    return out


def log_softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


class Vocabulary:
    """Numbers of tokens: the rank of a frequent word, beyond them a number for the ending."""

    def __init__(self, words: list[bytes], counts: np.ndarray, sizes: Sizes):
        self.size, self.words, self.sizes = len(words), words, sizes
        rank = np.arange(self.size)
        ends = np.fromiter(map(self.ending, words), np.int64, self.size)
        all_ends = np.concatenate([ends, np.arange(sizes.endings)])
        head_words = sizes.head_classes * sizes.width
        head = np.concatenate([rank < head_words, np.zeros(sizes.endings, bool)])
        own = np.concatenate([rank < sizes.own, np.zeros(sizes.endings, bool)])
        place = np.concatenate([rank, np.zeros(sizes.endings, np.int64)])
        self.bucket = np.where(own, place, sizes.own + all_ends % sizes.shared).astype(np.int32)
        self.cls = np.where(head, place // sizes.width, sizes.head_classes + all_ends // sizes.shared).astype(np.int32)
        self.inside = np.where(head, place % sizes.width, -1).astype(np.int32)
        self.hashes = np.fromiter(map(word_hash, words), np.uint64, self.size)
        #: log10 of a word's smoothed count; of the unseen, for words that are not frequent
        self.log_count = np.concatenate([np.log10(counts + 0.5), np.full(sizes.endings, np.log10(0.5))])

    def ending(self, word: bytes) -> int:
        return zlib.crc32(word[-ENDING_BYTES:]) % self.sizes.endings


class _Numbers(dict):
    """Token to number; a word that is not frequent has that of its ending."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__((w, i) for i, w in enumerate(vocabulary.words))
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        return self.vocabulary.size + self.vocabulary.ending(word)


def end_class(word: Column, sizes: Sizes) -> Column:
    """Tail class, from 0, by the ending of a word (binary)."""
    ending = F.when(F.length(word) < ENDING_BYTES, word).otherwise(F.substring(word, -ENDING_BYTES, ENDING_BYTES))
    return F.floor(F.crc32(ending) % F.lit(sizes.endings) / F.lit(sizes.shared)).cast("int")


def count_words(rows: DataFrame) -> DataFrame:
    """word (binary) and c over the training texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                found.update(tokens_of(text))
                if len(found) > HELD_WORDS:
                    yield pd.DataFrame({"word": list(found.keys()), "c": list(found.values())})
                    found.clear()
        if found:
            yield pd.DataFrame({"word": list(found.keys()), "c": list(found.values())})

    counted = rows.where("NOT held_out").select("text").mapInPandas(count, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[list[bytes], np.ndarray]:
    """At most ``most`` words above a common count, by falling count; their counts."""
    by_count = counts.groupBy(F.least("c", F.lit(20_000)).alias("c")).count().orderBy(F.col("c").desc())
    seen, least = 0, None
    for row in by_count.collect():  # at most 20,000 rows
        seen += row["count"]
        if seen > most:
            break
        least = row["c"]
    if least is None:
        least = 20_000  # then the most frequent words of a very large vocabulary, by a bounded sort
        table = counts.where(F.col("c") >= least).orderBy(F.col("c").desc(), "word").limit(most).toArrow()
    else:
        table = counts.where(F.col("c") >= least).toArrow()
    words, c = [bytes(w) for w in table.column("word").to_pylist()], table.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    return [words[i] for i in order], np.array([c[i] for i in order], np.int64)


def encoded(rows: DataFrame, vocabulary) -> DataFrame:
    """row (a number), id, held_out, and the tokens as numbers and the hashes of those that are not frequent, in their order; written."""

    @F.pandas_udf("numbers binary, rare binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        size, numbers = vocabulary.value.size, _Numbers(vocabulary.value)
        for texts in batches:
            out = []
            for text in texts:
                tokens = tokens_of(text)
                now = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
                rare = [word_hash(tokens[i]) for i in np.flatnonzero(now >= size).tolist()]
                out.append((now.tobytes(), np.array(rare, np.uint64).tobytes()))
            yield pd.DataFrame(out, columns=["numbers", "rare"])

    numbered = rows.select("id", "held_out", encode("text").alias("e")).withColumn("row", F.monotonically_increasing_id())
    return written(numbered.select("row", "id", "held_out", "e.*"))


class Batch:
    """Tokens of several texts one after another, each with the numbers of the two before it."""

    def __init__(self, numbers: list[bytes], rare: list[bytes], vocabulary: Vocabulary, end: int):
        self.lengths = np.array([len(n) // 4 for n in numbers], np.int64)
        self.start = np.cumsum(self.lengths) - self.lengths
        self.now = np.frombuffer(b"".join(numbers), np.int32)
        self.before = np.concatenate([[end], self.now[:-1]]).astype(np.int64)
        self.before[self.start] = end
        self.skipped = np.concatenate([[end], self.before[:-1]])
        self.skipped[self.start] = end
        self.rare_at = self.now >= vocabulary.size
        self.rare = np.frombuffer(b"".join(rare), np.uint64)

    def hashes(self, vocabulary: Vocabulary) -> np.ndarray:
        out = np.empty(len(self.now), np.uint64)
        out[~self.rare_at] = vocabulary.hashes[self.now[~self.rare_at]]
        out[self.rare_at] = self.rare
        return out

    def tail_pairs(self, vocabulary: Vocabulary, end_hash: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of tail tokens after a word without a history of its own; hash of that word and the class; the token's hash."""
        at = np.flatnonzero((vocabulary.inside[self.now] < 0) & (vocabulary.bucket[self.before] >= vocabulary.sizes.own))
        hashes = self.hashes(vocabulary)
        before = np.where(np.isin(at, self.start), np.uint64(end_hash), hashes[at - 1])
        return at, mixed(before ^ mixed(vocabulary.cls[self.now[at]].astype(np.uint64))), hashes[at]


def _batches(batch: pd.DataFrame, vocabulary: Vocabulary, end: int) -> Iterator[tuple[slice, Batch]]:
    for lo in range(0, len(batch), TEXTS_AT_ONCE):
        part = slice(lo, lo + TEXTS_AT_ONCE)
        yield part, Batch(batch["numbers"].iloc[part].tolist(), batch["rare"].iloc[part].tolist(), vocabulary, end)


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def pair_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(history + np.uint64(0x9E3779B97F4A7C15) * word)


def packed(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted cells and their counts, as steps from one to the next, compressed."""
    return zlib.compress(np.diff(cells, prepend=0).astype("<u4").tobytes() + counts.astype("<u8").tobytes(), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<u8", n, offset=4 * n).astype(np.int64)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    cells, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return cells, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)


def summed_cells(blobs: DataFrame, *keys: str) -> DataFrame:
    """One blob for each key, of the sums over all of its blobs, which stream by."""
    schema = ", ".join(f"{k} long" for k in keys) + ", cells binary"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            for *own, blob in batch[[*keys, "cells"]].itertuples(index=False):
                if own != key:
                    if held:
                        yield pd.DataFrame([[*key, packed(*_merged(held))]], columns=[*keys, "cells"])
                    key, held = own, []
                held.append(unpacked(blob))
                if len(held) >= 8:
                    held = [_merged(held)]
        if held:
            yield pd.DataFrame([[*key, packed(*_merged(held))]], columns=[*keys, "cells"])

    return blobs.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(add, schema)


def follow_counts(texts: DataFrame, vocabulary) -> DataFrame:
    """part and cells (a blob of row and outcome as one number, and its count): what followed in the training texts.

    A task hands on one blob for each part, no larger than the model; as many tasks as the root of their number share
    a sum, and those sums make the part's.
    """
    tasks = texts.rdd.getNumPartitions()
    salts = math.ceil(math.sqrt(tasks))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        vocab = vocabulary.value
        sizes, end = vocab.sizes, _Numbers(vocab)[END]
        waiting: list[np.ndarray] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def count_waiting() -> None:
            if waiting:
                held.append(np.unique(np.concatenate(waiting), return_counts=True))
                held[:] = [_merged(held)]
                waiting.clear()

        for batch in batches:
            for _, b in _batches(batch, vocab, end):
                before = vocab.bucket[b.before].astype(np.int64)
                cls, inside = vocab.cls[b.now], vocab.inside[b.now]
                waiting.append((before * sizes.buckets + vocab.bucket[b.skipped]) * sizes.width + cls)
                h = inside >= 0
                waiting.append((sizes.pairs + before[h] * sizes.head_classes + cls[h]) * sizes.width + inside[h])
                if sum(map(len, waiting)) >= CELLS_AT_ONCE:
                    count_waiting()
        count_waiting()
        if held:
            cells, counts = held[0]
            part = sizes.part_of(row_features(np.arange(sizes.rows), sizes)[:, 3])[cells // sizes.width]
            salt = TaskContext.get().partitionId() % salts
            rows = [(p, salt, packed(cells[part == p], counts[part == p])) for p in np.unique(part).tolist()]
            yield pd.DataFrame(rows, columns=["part", "salt", "cells"])

    found = texts.select("numbers", "rare").mapInPandas(count, "part long, salt long, cells binary")
    return summed_cells(summed_cells(found, "part", "salt").drop("salt"), "part")


def first_state(follows: DataFrame, sizes: Sizes) -> DataFrame:
    """A row for each part: row numbers and their counts of every outcome, and its own weights and their two moments, all zero; written."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, blob in zip(batch["part"].tolist(), batch["cells"], strict=True):
                cells, n = unpacked(blob)
                rows, at = np.unique(cells // sizes.width, return_inverse=True)
                counts = np.zeros((len(rows), sizes.width), np.float32)
                counts[at, cells % sizes.width] = n
                low, high = sizes.features_of(part)
                own = bytes(4 * (high - low) * sizes.width)
                yield pd.DataFrame({"part": [part], "rows": [rows.tobytes()], "counts": [counts.tobytes()], "weights": [own], "moments": [own + own], "gradient": [None]})

    packed_parts = written(follows)
    state = written(packed_parts.repartitionByRange(sizes.parts, "part").mapInPandas(gather, STATE))
    remove_written(packed_parts)
    return state


def moved(total: np.ndarray, weights: np.ndarray, first: np.ndarray, second: np.ndarray, step: int, rate: float) -> None:
    """One update of some features' weights and moments, in place; the last column of the gradient is the features' mass."""
    for lo in range(0, len(weights), UPDATE_ROWS):
        at = slice(lo, lo + UPDATE_ROWS)
        # a feature's gradient by its own mass, with a pull to zero that fades with the mass
        g = (total[at, :-1] - 4.0 * weights[at]) / (total[at, -1:] + 50.0)
        first[at] = 0.8 * first[at] + 0.2 * g
        second[at] = 0.95 * second[at] + 0.05 * g * g
        move = (first[at] / (1 - 0.8**step)) / (np.sqrt(second[at] / (1 - 0.95**step)) + 1e-4)
        weights[at] += (rate / np.sqrt(step) * move).astype(np.float32)


def train(follows: DataFrame, sizes: Sizes, updates: int = UPDATES, rate: float = 0.4) -> np.ndarray:
    """The weight matrix, in half precision, after gradient updates over the whole table of what follows what.

    A part's own weights and moments lie in its row of a table that each update writes anew: they change in the task
    that sums their gradient, and never meet the driver before the last update. It holds the common rows alone.
    """
    spark = follows.sparkSession
    state = first_state(follows, sizes)
    weights, first, second = (np.zeros((sizes.common, sizes.width), np.float32) for _ in range(3))
    sums = "slot long, gradient binary"

    def summed(slot: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(slot["gradient"].iloc[0], np.float32).copy()
        for blob in slot["gradient"].iloc[1:]:
            total += np.frombuffer(blob, np.float32)
        return pd.DataFrame({"slot": [slot["slot"].iloc[0] // FAN], "gradient": [total.tobytes()]})

    for step in range(1, updates + 1):
        shared = spark.sparkContext.broadcast(weights)

        def update(batches: Iterator[pd.DataFrame], shared=shared, step=step) -> Iterator[pd.DataFrame]:
            common, part = np.zeros((sizes.common, sizes.width + 1), np.float32), None
            for batch in batches:
                for part, rows, blob, own, moments in batch[["part", "rows", "counts", "weights", "moments"]].itertuples(index=False):
                    low, high = sizes.features_of(part)
                    mine = np.frombuffer(own, np.float32).reshape(-1, sizes.width).copy()
                    held = np.frombuffer(moments, np.float32).reshape(2, -1, sizes.width).copy()
                    # the common rows, the part's own ones, and the one of zeros
                    local = np.concatenate([shared.value, mine, np.zeros((1, sizes.width), np.float32)])
                    at = row_features(np.frombuffer(rows, np.int64), sizes)
                    at = np.where(at < sizes.common, at, np.where(at < sizes.features, at - low + sizes.common, len(local) - 1))
                    counts = np.frombuffer(blob, np.float32).reshape(-1, sizes.width)
                    size = counts.sum(1, keepdims=True)
                    error = np.concatenate([counts - size * np.exp(log_softmax(local[at].sum(1))), size], 1)
                    total = np.zeros((high - low, sizes.width + 1), np.float32)
                    for k in range(at.shape[1]):
                        real = np.flatnonzero(at[:, k] < len(local) - 1)
                        order = real[np.argsort(at[real, k], kind="stable")]
                        to, begin = np.unique(at[order, k], return_index=True)
                        if len(to):
                            added = np.add.reduceat(error[order], begin, axis=0)
                            if k < 3:
                                common[to] += added
                            else:
                                total[to - sizes.common] += added
                    moved(total, mine, held[0], held[1], step, rate)
                    yield pd.DataFrame({"part": [part], "rows": [rows], "counts": [blob], "weights": [mine.tobytes()], "moments": [held.tobytes()], "gradient": [None]})
            if part is not None:
                yield pd.DataFrame({"part": [-1 - part], "rows": [None], "counts": [None], "weights": [None], "moments": [None], "gradient": [common.tobytes()]})

        after = written(state.where("part >= 0").mapInPandas(update, STATE))
        tree, left = after.where("part < 0").select((-1 - F.col("part")).alias("slot"), "gradient"), sizes.parts
        while left > FAN:
            tree, left = tree.groupBy(F.floor(F.col("slot") / FAN)).applyInPandas(summed, sums), math.ceil(left / FAN)
        total = np.zeros((sizes.common, sizes.width + 1), np.float32)
        for r in tree.collect():  # the common rows, FAN times at most
            total += np.frombuffer(r["gradient"], np.float32).reshape(-1, sizes.width + 1)
        shared.destroy()
        remove_written(state)
        state = after
        moved(total, weights, first, second, step, rate)

    def halved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(weights=[np.frombuffer(w, np.float32).astype(np.float16).tobytes() for w in batch["weights"]])

    out = np.zeros((sizes.features + 1, sizes.width), np.float16)
    out[: sizes.common] = weights
    for r in state.where("part >= 0").select("part", "weights").mapInPandas(halved, "part long, weights binary").toLocalIterator():
        low, high = sizes.features_of(r["part"])
        out[low:high] = np.frombuffer(r["weights"], np.float16).reshape(-1, sizes.width)
    remove_written(state)
    return out


class Model:
    """Log probabilities (base 10) of classes and of words within them, kept for the rows that came up lately."""

    def __init__(self, weights: np.ndarray, sizes: Sizes, kept_floats: int = KEPT_FLOATS):
        self.weights, self.sizes = weights, sizes
        self.capacity = max(1, kept_floats // sizes.width)
        self.slot = np.full(sizes.rows, -1, np.int64)
        self.logs = np.zeros((0, sizes.width), np.float32)
        self.used = 0

    def __call__(self, rows: np.ndarray, outcomes: np.ndarray) -> np.ndarray:
        wanted = np.zeros(self.sizes.rows, bool)
        wanted[rows] = True
        fresh = np.flatnonzero(wanted & (self.slot < 0))
        if self.used + len(fresh) > self.capacity:
            self.slot[:] = -1
            self.used = 0
            fresh = np.flatnonzero(wanted)
        if self.used + len(fresh) > len(self.logs):
            more = np.zeros((max(2 * len(self.logs), self.used + len(fresh)), self.sizes.width), np.float32)
            more[: self.used] = self.logs[: self.used]
            self.logs = more
        for lo in range(0, len(fresh), 4096):
            some = fresh[lo : lo + 4096]
            self.logs[self.used : self.used + len(some)] = log_softmax(self.weights[row_features(some, self.sizes)].sum(1, dtype=np.float32)) / np.log(10)
            self.slot[some] = np.arange(self.used, self.used + len(some))
            self.used += len(some)
        return self.logs[self.slot[rows], outcomes].astype(float)


def pair_features(texts: DataFrame, counts: DataFrame, vocabulary, tail_mass: np.ndarray) -> DataFrame:
    """key and score: what pairs of words that recur, and their histories, add to the log of a tail word's frequency."""
    sizes = vocabulary.value.sizes

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary.value
        end = _Numbers(vocab)[END]
        for batch in batches:
            for _, b in _batches(batch, vocab, end):
                _, history, word = b.tail_pairs(vocab, word_hash(END))
                # what a batch repeats goes on once
                order = np.lexsort((word, history))
                history, word = history[order], word[order]
                at = np.flatnonzero(np.concatenate([[True], (history[1:] != history[:-1]) | (word[1:] != word[:-1])])) if len(order) else order
                yield pd.DataFrame({"history": _signed(history[at]), "word": _signed(word[at]), "n": np.diff(np.append(at, len(order)))})

    def recurring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted pairs stream by; of each history the pairs that recur, and how many pairs it has in all.

        Held are the pair that may go on, and of the history that may go on the recurring pairs and the sum.
        """
        pair, held, total = (np.zeros((0, 3), np.int64) for _ in range(3))  # total: a row of the history, nothing, and its sum

        def found(rows: np.ndarray, totals: np.ndarray) -> pd.DataFrame:
            history, word = rows[:, 0].copy(), rows[:, 1].copy()
            key = pair_key(history.view(np.uint64), word.view(np.uint64))
            return pd.DataFrame({"history": history, "word_hash": word, "key": _signed(key), "n": rows[:, 2], "total": totals})

        def added(groups: np.ndarray, ends: bool) -> pd.DataFrame | None:
            """Takes pairs with their sums; gives the histories that are complete, all of them at the end."""
            nonlocal held, total
            both = np.concatenate([total, groups])
            if not len(both):
                return None
            begins = np.flatnonzero(np.concatenate([[True], both[1:, 0] != both[:-1, 0]]))
            sums = np.add.reduceat(both[:, 2], begins)
            some = np.concatenate([held, groups[groups[:, 2] > 1]])
            at = np.searchsorted(both[begins, 0], some[:, 0])
            stays = np.zeros(len(some), bool) if ends else at == len(begins) - 1
            held = some[stays]
            total = np.array([[both[-1, 0], 0, sums[-1]]], np.int64)
            return found(some[~stays], sums[at[~stays]])

        for batch in batches:
            rows = np.concatenate([pair, batch.to_numpy(np.int64)])
            if not len(rows):
                continue
            at = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
            groups = np.column_stack([rows[at, :2], np.add.reduceat(rows[:, 2], at)])
            pair = groups[-1:]
            out = added(groups[:-1], False)
            if out is not None and len(out):
                yield out
        out = added(pair, True)
        if out is not None and len(out):
            yield out

    dealt = texts.select("numbers", "rare").mapInPandas(pairs, "history long, word long, n long").repartition("history").sortWithinPartitions("history", "word")
    active = dealt.mapInPandas(recurring, "history long, word_hash long, key long, n long, total long")
    mass = F.element_at(F.array(*[F.lit(float(m)) for m in tail_mass]), end_class(F.col("word"), sizes) + 1)
    shares = counts.select(F.xxhash64("word").alias("word_hash"), ((F.col("c") + 0.5) / mass).alias("share"))
    shared = active.join(shares, "word_hash")
    known = written(shared.select("history", "key", "share", ((F.col("n") - DISCOUNT) / F.col("total")).alias("p")))
    histories = known.groupBy("history").agg(F.log10((1 - F.sum("p")) / (1 - F.sum("share"))).alias("rest"))
    own = known.join(histories, "history").select("key", (F.log10(F.col("p") / F.col("share")) - F.col("rest")).alias("score"))
    return own.unionAll(histories.select(F.col("history").alias("key"), F.col("rest").alias("score")))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, sizes: Sizes | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; one row per input row."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(remainder(F.col(id_col), HELD_OUT_MODULUS) == HELD_OUT_REMAINDER, F.lit(False)).alias("held_out"),
    )
    counts = written(count_words(rows))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    sizes = sizes or Sizes.of(total)
    words, word_counts = frequent_words(counts, frequent)
    vocab = Vocabulary(words, word_counts, sizes)
    vocabulary = spark.sparkContext.broadcast(vocab)

    # the words outside the head by the class of their ending: smoothed total count of each class
    by_class = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy(end_class(F.col("word"), sizes).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tail = np.array([by_class.get(k, (0, 0)) for k in range(sizes.tail_classes)], float)
    for i, w in enumerate(words[: sizes.head_classes * sizes.width]):
        tail[vocab.ending(w) // sizes.shared] -= (word_counts[i], 1)
    tail_mass = tail[:, 0] + 0.5 * (tail[:, 1] + 1)
    base_log = float(np.log10(total + 0.5 * (distinct + 1)))

    texts = encoded(rows, vocabulary)
    training = texts.where("NOT held_out")
    weights = spark.sparkContext.broadcast(train(follow_counts(training, vocabulary), sizes))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, model = vocabulary.value, Model(weights.value, sizes)
        end, tail_log = _Numbers(vocab)[END], np.log10(tail_mass)
        for batch in batches:
            for part, b in _batches(batch, vocab, end):
                before = vocab.bucket[b.before].astype(np.int64)
                cls, inside = vocab.cls[b.now], vocab.inside[b.now]
                logs = model(before * sizes.buckets + vocab.bucket[b.skipped], cls)
                h = inside >= 0
                logs[h] += model(sizes.pairs + before[h] * sizes.head_classes + cls[h], inside[h])
                # a tail word's own log is that of an unseen word here if it is not frequent; what is asked for below adds the rest
                counted = vocab.log_count[b.now]
                logs[~h] += counted[~h] - tail_log[cls[~h] - sizes.head_classes]
                sums = (np.add.reduceat(x, b.start) for x in ((~b.rare_at).astype(np.int64), counted - base_log, logs))
                n_known, base_score, scores = sums
                yield pd.DataFrame({"row": batch["row"].iloc[part].to_numpy(), "n_tokens": b.lengths, "n_known": n_known, "base_score": base_score, "score": scores})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The keys of every word that is not frequent, and of every tail word after its history, and that history's."""
        vocab = vocabulary.value
        end, end_hash = _Numbers(vocab)[END], word_hash(END)
        for batch in batches:
            for part, b in _batches(batch, vocab, end):
                of = np.repeat(batch["row"].iloc[part].to_numpy(), b.lengths)
                at, history, word = b.tail_pairs(vocab, end_hash)
                one = np.uint64(1)  # keys of words are even, those of pairs and histories odd
                keys = np.concatenate([b.rare & ~one, history | one, pair_key(history, word) | one])
                yield pd.DataFrame({"row": np.concatenate([of[b.rare_at], of[at], of[at]]), "key": _signed(keys)})

    seen = F.log10(F.col("c") + F.lit(0.5)) - math.log10(0.5)
    least = int(word_counts[-1]) if len(word_counts) else 0  # words above it are all frequent
    told = counts.where(F.col("c") <= least).select(F.xxhash64("word").bitwiseAND(F.lit(-2)).alias("key"), seen.alias("base"), seen.alias("add"), F.lit(1).alias("known"))
    pairs = pair_features(training, counts, vocabulary, tail_mass)
    told = told.unionAll(pairs.select(F.col("key").bitwiseOR(F.lit(1)).alias("key"), F.lit(0.0).alias("base"), F.col("score").alias("add"), F.lit(0).alias("known")))
    asked = texts.select("row", "numbers", "rare").mapInPandas(ask, "row long, key long")
    late = asked.join(told, "key").groupBy("row").agg(F.sum("base").alias("base"), F.sum("add").alias("add"), F.sum("known").alias("known"))

    scored = texts.select("row", "numbers", "rare").mapInPandas(score, "row long, n_tokens long, n_known long, base_score double, score double")
    out = texts.select("row", "id", "held_out").join(scored, "row").join(late, "row", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("add", F.lit(0.0))).alias("score"),
    )
