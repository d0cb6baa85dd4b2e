"""SimHash near-duplicates with pivot distance tables.

Each text becomes a 64-bit fingerprint. Two fingerprints are linked if at most ``RADIUS`` bits
differ. A table holds each distinct fingerprint's Hamming distances to ``PIVOTS`` reference
fingerprints, computed once. Of every pair that comes up, the table decides first: a pair whose
distances to any reference differ by more than the radius cannot be linked and is discarded, and
the survivors are verified bit by bit.

Which pairs come up: distances to a reference spread by about four bits, as much as the radius, so
ranges of distances cannot keep unlinked fingerprints apart. Pairs therefore meet where blocks of
bits agree, without loss: of ``BLOCKS`` blocks at least ``BLOCKS - RADIUS`` are equal in a linked
pair, so it shares the bucket of at least one choice of that many blocks. The bits that a crowded
bucket leaves open are cut into blocks once more, and a bucket that stays crowded is dealt over
cells of two sub-buckets each, so that every pair still meets. A bucket yields a spanning forest of
its links, not all pairs. Components come from star contractions.

Rows of equal fingerprints are one node throughout; component_id is the smallest doc_id of all rows
in a component. Joins on fingerprints, roots and buckets broadcast the frequent keys (``meet``), so
that no task takes a large group.

Defined results: null text counts as empty, whose fingerprint is zero; a null id gets the smallest
id of its component (null if there is none); rows that repeat get the same component each; an empty
table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import LOWER_BYTES, cut, frequent_keys, meet, whole_row
from lintel.llm.components import star_components

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
#: Reference fingerprints: two longs of eight distances each.
PIVOTS = 16
#: Rows of a bucket from which it is crowded.
BUCKET_ROWS = 2048
#: Runs up to this size are compared pair by pair, larger ones by search from each row on.
SMALL_RUN = 8

_PIVOTS = np.random.default_rng(11).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The majority of each bit over the XXH64 of the word shingles, as an unsigned number."""
    import xxhash

    # bytes.split() cuts at the six separators and at no other byte
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(sizes) >= SHINGLE_WORDS:
        starts, ends = starts[: -SHINGLE_WORDS + 1], ends[SHINGLE_WORDS - 1 :]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    else:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column) -> Column:
    """The fingerprint's bits as a signed long."""

    @F.pandas_udf("long")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return compute(text)


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """One row of distances to the reference fingerprints for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ _PIVOTS[None, :]).astype(np.int8)


def pivot_table(nodes: DataFrame) -> DataFrame:
    """fp and its distances, eight to a long."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            packed = pivot_distances(fps.view(np.uint64)).view(np.int64)
            yield pd.DataFrame({"fp": fps, "near": packed[:, 0], "far": packed[:, 1]})

    return nodes.select("fp").mapInPandas(measure, "fp long, near long, far long")


def pivot_survivors(pivots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs (a[i], b[i]), the places of those that no reference discards: the largest coordinate difference is within the radius."""
    alive = np.arange(len(a))
    for p in range(pivots.shape[1]):
        gap = pivots[a[alive], p] - pivots[b[alive], p]
        alive = alive[np.abs(gap) <= RADIUS]
    return alive


def _near(fps: np.ndarray, pivots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) are linked: the pivot table discards, the bits verify."""
    alive = pivot_survivors(pivots, a, b)
    out = np.zeros(len(a), bool)
    out[alive] = np.bitwise_count(fps[a[alive]] ^ fps[b[alive]]) <= RADIUS
    return out


def _search_run(fps: np.ndarray, pivots: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of a spanning forest over one run, found by searching outward from each unreached row."""
    waiting = np.arange(len(fps))
    left, right = [], []
    while len(waiting) > 1:
        front, waiting = waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            some, front = front[:128], front[128:]
            gap = np.abs(pivots[some, 0][:, None] - pivots[waiting, 0][None, :])
            a, b = np.nonzero(gap <= RADIUS)
            linked = _near(fps, pivots, some[a], waiting[b])
            reached, first = np.unique(b[linked], return_index=True)
            if len(reached):
                left += some[a[linked][first]].tolist()
                right += waiting[reached].tolist()
                front = np.concatenate([front, waiting[reached]])
                waiting = np.delete(waiting, reached)
    return left, right


def links_of_runs(keys: np.ndarray, fps: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints among rows that are sorted by key, by runs of equal keys."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(keys)))
    size_at = np.repeat(sizes, sizes)
    left, right = [], []
    small = size_at <= SMALL_RUN
    for step in range(1, SMALL_RUN):
        a = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:])) if len(keys) > step else np.zeros(0, np.int64)
        if not len(a):
            break
        a = a[_near(fps, pivots, a, a + step)]
        left.append(fps[a])
        right.append(fps[a + step])
    for at, size in zip(starts[sizes > SMALL_RUN].tolist(), sizes[sizes > SMALL_RUN].tolist(), strict=True):
        run = slice(at, at + size)
        a, b = _search_run(fps[run], pivots[run])
        left.append(fps[run][a])
        right.append(fps[run][b])
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _agreeing(bits: list[int]) -> list[list[int]]:
    """The choices of blocks, over the given bits, of which one agrees in each linked pair; a choice is its bits."""
    edges = [round(len(bits) * k / BLOCKS) for k in range(BLOCKS + 1)]
    block = [bits[lo:hi] for lo, hi in zip(edges, edges[1:], strict=False)]
    return [[b for i in chosen for b in block[i]] for chosen in combinations(range(BLOCKS), BLOCKS - RADIUS)]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _crowded(keyed: DataFrame, bucket_rows: int) -> DataFrame | None:
    """bucket and its rows n where there are more than ``bucket_rows``; None if there is no such bucket."""
    found = cut(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows))
    return None if found.isEmpty() else found


def _marked(keyed: DataFrame, crowded: DataFrame, bucket_rows: int) -> DataFrame:
    """The rows with n, null where the bucket is not crowded. The most crowded buckets are broadcast, no other has many rows."""
    often, seldom = frequent_keys(crowded, "n", bucket_rows)
    first = keyed.join(F.broadcast(often), "bucket", "left")
    rest = first.where("n IS NULL").drop("n").join(seldom, "bucket", "left")
    return first.where("n IS NOT NULL").unionByName(rest)


def near_links(nodes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """a and b: links between distinct fingerprints that keep every component connected."""
    table = cut(pivot_table(nodes))
    columns = ["fp", "near", "far"]
    choices = _agreeing(list(range(64)))
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_mask(bits)))).alias("bucket")) for t, bits in enumerate(choices)])
    keyed = table.select(*columns, F.explode(keys).alias("k")).select(*columns, "k.t", "k.bucket")
    celled = keyed.select(*columns, F.col("bucket").alias("cell"))
    if (crowded := _crowded(keyed, bucket_rows)) is not None:
        marked = _marked(keyed, crowded, bucket_rows)
        celled = marked.where("n IS NULL").select(*columns, F.col("bucket").alias("cell"))
        # the bits outside the agreeing blocks hold all differences: they are cut into blocks in turn
        open_masks = [[_mask(bits) for bits in _agreeing([b for b in range(64) if b not in chosen])] for chosen in choices]
        inner = F.element_at(F.array(*[F.array(*map(F.lit, masks)) for masks in open_masks]), F.col("t") + 1)
        buckets = F.transform(inner, lambda m, i: F.xxhash64("bucket", i, F.col("fp").bitwiseAND(m)))
        again = cut(marked.where("n IS NOT NULL").select(*columns, F.explode(buckets).alias("bucket")))
        if (still := _crowded(again, bucket_rows)) is None:
            celled = celled.unionAll(again.select(*columns, F.col("bucket").alias("cell")))
        else:
            subs = F.ceil(F.col("n") / bucket_rows).cast("int")
            own = F.pmod(F.xxhash64("fp", F.lit(5)), subs).cast("int")
            others = F.filter(F.sequence(F.lit(0), subs - 1), lambda x: x != own)
            cells = F.transform(others, lambda x: F.xxhash64("bucket", F.least(x, own), F.greatest(x, own)))
            dealt = F.when(F.col("n").isNull(), F.array("bucket")).otherwise(cells)
            celled = celled.unionAll(_marked(again, still, bucket_rows).select(*columns, F.explode(dealt).alias("cell")))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, rows = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch["cell"].to_numpy(np.int64)])
            rows = np.concatenate([rows, batch[columns].to_numpy(np.int64)])
            if not len(keys) or keys[0] == keys[-1]:
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
            yield linked(keys[:whole], rows[:whole])
            keys, rows = keys[whole:], rows[whole:]
        if len(keys):
            yield linked(keys, rows)

    def linked(keys: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
        pivots = np.ascontiguousarray(rows[:, 1:]).view(np.int8).reshape(len(rows), PIVOTS)
        a, b = links_of_runs(keys, np.ascontiguousarray(rows[:, 0]).view(np.uint64), pivots)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    sorted_cells = celled.repartition("cell").sortWithinPartitions("cell")
    return sorted_cells.mapInPandas(link, "a long, b long").distinct()


def _rooted(nodes: DataFrame) -> DataFrame:
    """The nodes (cut, one row per fp) with root, the smallest fingerprint of their component."""
    roots = star_components(near_links(nodes))
    return cut(nodes.join(roots, nodes["fp"] == roots["node"], "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id; one row per input row."""
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")))
    nodes = _rooted(cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n"))))
    least = cut(nodes.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("nodes")))
    members = cut(meet(nodes, least, "root", "nodes").select("fp", "component_id", "n"))
    return meet(rows, members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest identifier, null last.

    Rows are told apart by their place, so rows that share an identifier but not a component all stay.
    """
    rows = cut(docs.select(whole_row(docs), F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")))
    rows = rows.withColumn("number", F.monotonically_increasing_id())  # of a cut table: the same whenever it is read
    first = F.struct(F.col("id").isNull().alias("none"), "id", "number")
    nodes = _rooted(cut(rows.groupBy("fp").agg(F.min(first).alias("first"))))
    kept = nodes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.number").alias("number"))
    return rows.join(kept, "number", "left_semi").select("row.*")
