"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and the ASCII controls tab to carriage return.
WORD_SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A key is frequent if it has more rows than this and than one in FREQUENT_SHARE of all: there are fewer such keys than FREQUENT_SHARE.
FREQUENT_ROWS = 128
FREQUENT_SHARE = 10_000
#: While it is on, the shuffle files of a query go when the query ends: what is written needs them no more.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; one of our own only where all tasks run in this process, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lintel-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write the rows as compressed Parquet to the shared folder and read them again. Loops cut so: the planner's guess of a cut
    table's size is that of the plan it came from, which grows from round to round; a file has the size it has."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEAN_UP, before) if before is not None else conf.unset(CLEAN_UP)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written(df: DataFrame) -> None:
    """Delete the folder of a table that ``written`` made, once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if not re.fullmatch(r"written-[0-9a-f]{32}", folder.rsplit("/", 1)[1]):
            raise ValueError(f"{folder} is no written table")
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def frequent_keys(per_key: DataFrame, count_col: str, least: int = FREQUENT_ROWS, share: int = FREQUENT_SHARE) -> tuple[DataFrame, DataFrame]:
    """The rows of frequent keys (fewer than ``share``, so they may be broadcast) and all others; one row per key comes in."""
    total = per_key.agg(F.coalesce(F.sum(count_col), F.lit(0))).first()[0]
    bound = max(least, -(-int(total) // share))
    return per_key.where(F.col(count_col) > bound), per_key.where(F.col(count_col) <= bound)


def meet(rows: DataFrame, per_key: DataFrame, key: str, count_col: str = "n", least: int = FREQUENT_ROWS, share: int = FREQUENT_SHARE) -> DataFrame:
    """Rows with the columns of their key's row, for a table of one row per key and its number of rows.

    Frequent keys are broadcast, so their rows stay where they are; the others are joined by a
    shuffle in which no key has many rows. Both inputs should be cut: they are read more than once.
    """
    often, seldom = frequent_keys(per_key, count_col, least, share)
    others = [c for c in per_key.columns if c not in (key, count_col)]
    marked = rows.join(F.broadcast(often.drop(count_col).withColumn("_often", F.lit(True))), key, "left")
    met = marked.where("_often").select(*rows.columns, *others)
    rest = marked.where("_often IS NULL").select(*rows.columns)
    return met.unionAll(rest.join(seldom.drop(count_col), key).select(*rows.columns, *others))


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null where the id is null."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def ascii_lower(text: str) -> str:
    return text.translate(_ASCII_LOWER)


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: The same for UTF-8 bytes.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str) -> list[str]:
    """The words of a text: maximal runs without the six ASCII separators."""
    if text.isascii() and not _ODD_ASCII.intersection(text):
        return text.split()
    for sep in "\x09\x0a\x0b\x0c\x0d":
        if sep in text:
            text = text.replace(sep, " ")
    return [w for w in text.split(" ") if w]


#: str.split() also cuts at these ASCII controls, which are parts of words here.
_ODD_ASCII = frozenset("\x1c\x1d\x1e\x1f")
