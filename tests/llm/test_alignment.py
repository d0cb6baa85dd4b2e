import hashlib
from collections import Counter

import pytest

from lintel.llm import alignment
from lintel.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SPECIAL = ["<|endoftext|> a <s> b </s> <unk>", "▁ mark", "nul \x00 end", "  two  spaces \n\n tabs\t\t", "ⅷ ﬁ é ꟺ 𐐀 ͸ ‍", "中文字 かな 한글 😀😀", "don't we'll I'm 1234567"]


def _library():
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    letters = alignment._byte_letters()
    return tokenizer, letters, sentencepiece.SentencePieceProcessor(model_file=B)


def _brute_force(texts):
    """One text after the other, one token after the other."""
    tokenizer, letters, pieces = _library()
    found = []
    for text in texts:
        wanted = b" " + (text or "").encode()
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
        if not text or b"".join(a_bytes) != wanted or b"".join(b_bytes) != wanted:
            found.append(None)
            continue
        ends = []
        for side in (a_bytes, b_bytes):
            at = 0
            ends.append([at := at + len(x) for x in side])
        place = {end: k for k, end in enumerate(ends[1])}
        shared = set(ends[0]) & set(place)
        groups, links, open_a = [], [], []
        at_b = 0
        for i, end in zip(a, ends[0], strict=True):
            open_a.append(i)
            if end in shared:
                stop = place[end] + 1
                groups.append((open_a, b[at_b:stop]))
                links.append((i, b[stop - 1]))
                open_a, at_b = [], stop
        found.append((a, b, groups, links))
    counts = Counter(link for f in found if f for link in f[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest()))
    return rows


@pytest.fixture(scope="module")
def mixed(spark, odd_docs):
    texts = [r["text"] for r in odd_docs.select("text").collect()] + SPECIAL
    some = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    return spark.createDataFrame(list(enumerate(texts + some)), "doc_id long, text string")


@pytest.mark.parametrize(("often", "stretch", "held"), [(alignment.OFTEN, alignment.STRETCH, alignment.HELD_LINKS), (50, 64, 100), (1, 7, 1)])
def test_against_brute_force(mixed, often, stretch, held):
    """However small the stretches, however few pairs are broadcast, however many parts the links come in."""
    rows = mixed.orderBy("doc_id").collect()
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokenizers(mixed, A, B, often=often, stretch=stretch, held_links=held).collect()}
    assert [found[r["doc_id"]] for r in rows] == _brute_force([r["text"] for r in rows])


def test_odd_rows(odd_docs, no_docs):
    found = alignment.align_tokenizers(odd_docs, A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = found.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd_docs.collect())
    assert sum(r["n_a"] == 0 and r["groups_sha256"] == "" for r in rows) == 4  # null, empty, null without an id, a space mark in the text
    assert alignment.align_tokenizers(no_docs, A, B).count() == 0


def test_fast_encoder_equals_the_library(small):
    _, _, pdf, _ = small
    tokenizer, _, _ = _library()
    side = alignment.ByteSide(A)
    texts = [" " + t for t in [*pdf["text"][:300], *SPECIAL, "x" * 3000, " " * 500, "a'S 'll I'LL\r\n\r\n x"]]
    assert side.encode(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sum(alignment._SETTLED.search(t) is None for t in texts) > 300
