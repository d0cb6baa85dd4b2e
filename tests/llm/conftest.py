import pytest

LONG = " ".join(f"word{i % 977}" for i in range(20_000))
TEXTS = [
    None,
    "",
    " \t\n ",
    "One short line.",
    "same text here",
    "same  text\there",
    "Same text here",
    LONG,
    "x" * 50_000,
    "12 34 -- !!",
    "naïve café 中文 😀 ﬁ ▁ end",
]
#: Extra columns whose names clash with names that operators use inside.
EXTRA = "id long, norm string, sha string, salt int, row long, key string, word string, c long, fp long, cell long, u long, v long, node long, root long, part int, label int, h long, n long, host string, shard int, html_ string"


def _extra(n):
    return tuple(None if k % 2 else (n if t != "string" else "x") for k, t in enumerate(c.split()[1] for c in EXTRA.split(", ")))


DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows, an id that repeats with another text, clashing names."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, *_extra(i)) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[7], (None, "same text here", None, None, None, *_extra(99)), (None, None, None, None, None, *_extra(98)), (3, "another text of id three", "en", "s", 1, *_extra(3))]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 0, 1), (None, 1, 1), (7, None, None), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    """A thousand synthetic documents as pandas, with their labels."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return docs, labels, docs.toPandas(), labels.toPandas()
