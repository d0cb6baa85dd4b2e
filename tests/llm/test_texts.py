import hashlib
import math
import pathlib
import re
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintel.llm import common, html_text, maxent_lm, packing, pieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def sentencepiece_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abehint  \n\t.,'é▁中文😀\x00ﬁ0#*")), max_size=80))
def test_pieces_equal_the_library(text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = pieces.piece_model(PIECES)
    ids = model.encode(text)
    assert ids == sp.encode(text) and model.decode(ids) == sp.decode(ids)


def test_pieces_of_odd_rows(odd_docs, no_docs, sentencepiece_model):
    rows = {(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()}
    out = pieces.encoded_digests(odd_docs, PIECES).collect()
    assert len(out) == odd_docs.count()
    expected = set()
    for i, text in rows:
        ids = sentencepiece_model.encode(text or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), sentencepiece_model.decode(ids))]
        expected.add((i, len(ids), *digests))
    assert {tuple(r) for r in out} == expected
    round_trip = pieces.decode_documents(pieces.encode_documents(odd_docs, PIECES), PIECES)
    assert round_trip.count() == odd_docs.count() and pieces.encoded_digests(no_docs, PIECES).count() == 0


def test_packing_of_odd_rows(odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    out = packing.pack_documents(odd_docs, WORDS).toPandas()
    expected = Counter()
    for r in odd_docs.select("doc_id", "text").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected[(-1 if r["doc_id"] is None else r["doc_id"], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(int(x) for x in row) for row in out[columns].fillna(-1).itertuples(index=False)) == expected
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 2048
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_open_bins_take_the_tightest_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0)  # 4 free
    assert bins.place(7) == (1, 0)  # 3 free
    assert bins.place(3) == (1, 7)  # fits both; the tighter one, now full
    assert bins.place(8) == (2, 0)  # 2 free
    assert bins.place(9) == (3, 0)  # bin 2 was the fullest and closed
    assert bins.place(2) == (0, 6)
    assert bins.place(1) == (3, 9)


def test_one_id_for_all_pieces_is_dealt_over_parts(spark):
    pieces = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "0L AS start", "1 + id % 900 AS length", "0L AS ids_crc32")
    out = packing.pack_pieces(pieces, per_part=500).toPandas()
    by_part = (out["sequence_id"] // 2**40).value_counts()
    assert len(by_part) == 8 and by_part.min() > 300 and len(out) == 4000


def test_packing_fills_sequences(small):
    docs = small[0]
    out = packing.pack_documents(docs, WORDS).toPandas()
    assert out["length"].sum() / 2048 / out["sequence_id"].nunique() > 0.93


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abTHé'  \n\t09!<|>endoftxİΣσς\x1c\x85")), max_size=40), max_size=5))
def test_word_tokens_equal_the_library(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    found = [np.frombuffer(b, "<u4").tolist() for b in packing.word_tokens(WORDS).encode(texts)]
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


@pytest.mark.parametrize("frequent", [400_000, 50])
def test_base_scores_against_brute_force(odd_docs, frequent):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    counts = Counter()
    for i, text in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(_tokens(text))
    total = sum(counts.values())
    bottom = math.log10(total + 0.5 * (len(counts) + 1))
    expected = Counter()
    for i, text in rows:
        words = _tokens(text)
        expected[(i, len(words), sum(counts[w] > 0 for w in words), round(sum(math.log10(counts[w] + 0.5) - bottom for w in words), 4))] += 1
    out = maxent_lm.score_documents(odd_docs, frequent=frequent).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in out) == expected
    assert {r["train_tokens"] for r in out} == {total} and all(math.isfinite(r["score"]) for r in out)


def test_word_hashes_are_those_of_spark(spark):
    words = [b"", b"a", b"abc", "h\u00e9llo".encode(), b"x" * 70]
    rows = spark.createDataFrame([(w,) for w in words], "word binary").select(F.xxhash64("word")).collect()
    assert [r[0] % 2**64 for r in rows] == [maxent_lm.word_hash(w) for w in words]
    sizes = maxent_lm.Sizes(64)
    vocab = maxent_lm.Vocabulary([], np.zeros(0), sizes)
    rows = spark.createDataFrame([(w,) for w in words], "word binary").select(maxent_lm.end_class(F.col("word"), sizes)).collect()
    assert [r[0] for r in rows] == [vocab.ending(w) // sizes.shared for w in words]


def _brute_scores(rows, trained, weights, sizes, frequent):
    """log10 probability of each text, token by token, from plain counts and the weight matrix."""
    texts = [maxent_lm.tokens_of(t) for t in rows]
    counts = Counter(w for t, use in zip(texts, trained, strict=True) if use for w in t)
    ranked = sorted(counts, key=lambda w: (-counts[w], w))[:frequent]
    rank = {w: i for i, w in enumerate(ranked)}
    head = sizes.head_classes * sizes.width

    def ending(w):
        return zlib.crc32(w[-maxent_lm.ENDING_BYTES :]) % sizes.endings

    def is_head(w):
        return rank.get(w, head) < head

    def bucket(w):
        return rank[w] if rank.get(w, sizes.own) < sizes.own else sizes.own + ending(w) % sizes.shared

    def cls(w):
        return rank[w] // sizes.width if is_head(w) else sizes.head_classes + ending(w) // sizes.shared

    mass = [0.5] * sizes.tail_classes
    for w, n in counts.items():
        if not is_head(w):
            mass[ending(w) // sizes.shared] += n + 0.5
    share = {w: (n + 0.5) / mass[ending(w) // sizes.shared] for w, n in counts.items() if not is_head(w)}
    followers = {}
    for t, use in zip(texts, trained, strict=True):
        for before, w in zip([b"\n", *t], t, strict=False):
            if use and not is_head(w) and bucket(before) >= sizes.own:
                followers.setdefault((before, cls(w)), Counter())[w] += 1

    def softmax(row, outcome):
        logits = weights[maxent_lm.row_features(np.array([row]), sizes)[0]].astype(float).sum(0)
        return math.log10(math.exp(logits[outcome]) / np.exp(logits).sum())

    out = []
    for t in texts:
        total = 0.0
        for skipped, before, w in zip([b"\n", b"\n", *t], [b"\n", *t], t, strict=False):
            total += softmax(bucket(before) * sizes.buckets + bucket(skipped), cls(w))
            if is_head(w):
                total += softmax(sizes.pairs + bucket(before) * sizes.head_classes + cls(w), rank[w] % sizes.width)
                continue
            own = share.get(w, 0.5 / mass[ending(w) // sizes.shared])
            seen = followers.get((before, cls(w)), Counter()) if bucket(before) >= sizes.own else Counter()
            again = {x: (n - maxent_lm.DISCOUNT) / seen.total() for x, n in seen.items() if n > 1}
            if w in again:
                total += math.log10(again[w])
            elif again:
                total += math.log10(own * (1 - sum(again.values())) / (1 - sum(share[x] for x in again)))
            else:
                total += math.log10(own)
        out.append(total)
    return out


@pytest.mark.parametrize("frequent", [100_000, 700])
def test_scores_against_brute_force(small, monkeypatch, frequent):
    docs = small[0].where("doc_id < 60")
    sizes = maxent_lm.Sizes(16)
    kept = []
    train = maxent_lm.train
    monkeypatch.setattr(maxent_lm, "train", lambda *a, **k: kept.append(train(*a, **k)) or kept[-1])
    out = maxent_lm.score_documents(docs, frequent=frequent, sizes=sizes).toPandas().set_index("doc_id")
    rows = docs.select("doc_id", "text").toPandas()
    trained = [zlib.crc32(str(i).encode()) % 5 != 1 for i in rows["doc_id"]]
    expected = _brute_scores(rows["text"], trained, kept[0], sizes, frequent)
    assert np.allclose(out.loc[rows["doc_id"], "score"], expected, rtol=1e-5)


def test_gradients_of_many_parts_are_summed_in_a_tree(small, monkeypatch):
    """Many parts and a fan of two give the weights that one part gives."""
    rows = small[0].where("doc_id < 300").selectExpr("doc_id AS id", "text", "false AS held_out").repartition(12)
    counts = maxent_lm.count_words(rows).toPandas().sort_values(["c", "word"], ascending=False)
    words, n = [bytes(w) for w in counts["word"]], counts["c"].to_numpy()
    one, many = maxent_lm.Sizes(32), maxent_lm.Sizes(32, part_rows=300)
    assert one.parts == 1 and many.parts > 8
    out = []
    for sizes, fan in ((one, maxent_lm.FAN), (many, 2)):
        monkeypatch.setattr(maxent_lm, "FAN", fan)
        shared = rows.sparkSession.sparkContext.broadcast(maxent_lm.Vocabulary(words, n, sizes))
        out.append(maxent_lm.train(maxent_lm.follow_counts(maxent_lm.encoded(rows, shared), shared), sizes, updates=2))
    assert np.allclose(*out, atol=1e-3)


def test_training_leaves_no_tables(small):
    """Tables of parts go as the next one stands; what is no written table is not touched."""
    spark = small[0].sparkSession
    rows = small[0].where("doc_id < 40").selectExpr("doc_id AS id", "text", "false AS held_out")
    counts = maxent_lm.count_words(rows).toPandas()
    sizes = maxent_lm.Sizes(8, part_rows=40)
    shared = spark.sparkContext.broadcast(maxent_lm.Vocabulary([bytes(w) for w in counts["word"]], counts["c"].to_numpy(), sizes))
    texts = maxent_lm.encoded(rows, shared)
    folder = pathlib.Path(urllib.parse.urlparse(spark.sparkContext.getCheckpointDir()).path)
    before = set(folder.iterdir())
    weights = maxent_lm.train(maxent_lm.follow_counts(texts, shared), sizes, updates=2)
    assert set(folder.iterdir()) == before
    assert weights.shape == (sizes.features + 1, sizes.width) and not weights[-1].any() and weights[: sizes.common].any() and weights[sizes.common :].any()
    with pytest.raises(ValueError):
        common.remove_written(small[0])


def test_model_beats_the_base_on_held_out_documents(small):
    out = maxent_lm.score_documents(small[0]).toPandas()
    held = out[out["held_out"]]
    assert (held["score"].sum() - held["base_score"].sum()) / held["n_tokens"].sum() > 0.15


def test_scores_of_no_rows(no_docs):
    assert maxent_lm.score_documents(no_docs).count() == 0


def test_the_model_grows_with_the_corpus():
    assert [maxent_lm.Sizes.of(n).width for n in (0, 10**5, 10**7, 10**10, 10**13)] == [8, 32, 64, 256, 1024]


def test_class_and_word_probabilities_sum_to_one():
    sizes = maxent_lm.Sizes(16)
    weights = np.random.default_rng(0).normal(0, 1, (sizes.features + 1, sizes.width)).astype(np.float32)
    for kept in (10**6, 4 * sizes.width):  # also where rows do not stay
        model = maxent_lm.Model(weights, sizes, kept)
        for rows in ([0, 5, sizes.pairs], [sizes.rows - 1, 5, 7]):
            at = np.repeat(rows, sizes.width)
            p = 10 ** model(at, np.tile(np.arange(sizes.width), len(rows)))
            assert np.allclose(p.reshape(len(rows), -1).sum(1), 1, atol=1e-4)


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class='ad'>Buy &amp; go</div>"
    "<article><h1>A &lt;head&gt;</h1><p>One <b>two</b>&nbsp;three<br>four<p>five &eacute;&#33;<div id='comments'>no</div></article>"
    "<footer>&copy; x</footer></body></html>"
)


def _text(page):
    """Main text of a page alone on its host."""
    articles, outside, sure = html_text.page_parts(page)
    return html_text.vote(articles, outside, np.zeros(0, np.int64), sure)


def test_article_pages():
    assert _text(PAGE) == "A <head> One two three four five é!"
    assert html_text.page_blocks(None) == [] and _text("<p>a <b") == "a"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<b><nav><b>x</b> y</nav>z</b>", "z"),
        ("<b><article>one more</b> two</article>three", "one more two"),
        ("<article>a <span class='ad'>no <span>no</span> no</span> b <i>c</i></article>", "a b c"),
        ("<article><p>a<div class='notice'>no<p>no</div>b</article>", "a b"),
        ("<main><h1>T</h1><aside>no</aside><ul><li>x<li>y</ul><form>no</form></main>", "T x y"),
        ("<article>a<!-- no <p>no</p> -->b<script>if (a < b) '</p>'</script>c</article", "abc"),
        ('<body><svg class="i"/><article><p>Text</p><svg><text>no</text></svg></article>', "Text"),
        ('<div class="layout has-sidebar"><article>x y</article></div>', "x y"),
        ('<div class="site widget-area-none"><main>x</main></div>', "x"),
        ('<div class="sidebar-layout"><article>x y</article><p>no</p></div>', "x y"),
        ('<article><p class="notice">a</p><div class="related-work">b</div><p>x</p></article>', "a b x"),
        ("<p data-x=don't>I don't know it</p>", "I don't know it"),
        ("<!-- <article> --><script>'<article>'</script><div>the story</div>", "the story"),
        ('<section id="comments"><article>no</article></section><p>yes it is</p>', "yes it is"),
        ('<div class="sidebar"><article>teaser</article></div><article>a longer story</article>', "a longer story"),
        ("<div><p>the real story has many words</p></div><article>teaser</article><article>two</article>", "the real story has many words"),
        ("<article>the one story, told at length</article><article>another</article><div>few words</div>", "the one story, told at length another"),
        ("<article>short story</article><div class='rail'>" + "word " * 30 + "</div>", "short story"),
        ("<article>short story</article><div>" + "word " * 30 + "</div>", "short story"),
        ("<main>a b c</main><div>x y z w</div>", "a b c"),
        ("<main><article>a b</article><article>c</article></main><article>no</article>", "a b c"),
        ("<article>a<div class='post-comments'>no</div><ol class='comment-list'><li>no</ol><div class='ad-slot'>no</div><div class='cookie-banner'>no</div>b</article>", "a b"),
        ("<article>a<div class='widget'>b</div><div class='commentary'>c</div></article>", "a b c"),
        ("<form id='aspnetForm'><div>no</div><article>the story</article></form>", "the story"),
        ("<form id='aspnetForm'><nav>no</nav><div>the <b>story</b></div><p>goes on</p></form>", "the story goes on"),
        ("<form><input><label>no</label></form><p>yes</p>", "yes"),
        ("<aside><article>the story</article></aside>", "the story"),
        ("<aside><article>a teaser</article></aside><div>the story is longer</div>", "the story is longer"),
        ("<article>a<form>no</form><aside>no</aside>b</article>", "a b"),
        ('<p hidden>no</p><p class="overflow hidden">yes</p>', "yes"),
    ],
)
def test_parts_that_go(page, text):
    assert _text(page) == text


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("batch_pages", [500, 4])
def test_host_boilerplate_goes_and_unique_runs_stay(spark, batch_pages):
    """Also where the host's pages are dealt over batches: what recurs adds up."""
    chrome = "welcome to our site please read all of the rules before you post"
    rows = [(i, f"https://host.example/{i}", f"<div><p>{chrome}</p><p>n{i} a{i} b{i}</p><p>{chrome}</p></div>") for i in range(12)]
    rows += [(100 + k, f"https://host.example/{100 + k}", rows[0][2]) for k in range(9)] + [(None, None, None), (102, "https://other.example/", "<p>alone</p>")]
    # an article that many pages copy, and words outside of it that they share, too
    rows += [(200 + k, f"https://host.example/{200 + k}", f"<p>{chrome}</p><article>a story that is copied in full on many pages of this host</article>") for k in range(9)]
    # no boilerplate: too few pages
    rows += [(300 + k, f"https://host.example/{300 + k}", f"<p>o{k}</p><p>{' '.join(f'quote{j}' for j in range(12))}</p>") for k in range(3)]
    out = {r["page_id"]: r["text"] for r in html_text.extract_main_text(_pages(spark, rows), batch_pages=batch_pages).collect()}
    assert out[3] == "n3 a3 b3" and out[0] == "n0 a0 b0" and {out[100 + k] for k in range(9) if k != 2} == {"n0 a0 b0"}
    assert out[None] == "" and out[102] == "alone"
    assert {out[200 + k] for k in range(9)} == {"a story that is copied in full on many pages of this host"}
    assert out[301] == "o1 " + " ".join(f"quote{j}" for j in range(12))


@pytest.mark.parametrize("batch_pages", [500, 3, 1])
def test_boilerplate_is_counted_over_the_whole_host(spark, batch_pages):
    """A passage on six pages goes however the pages are dealt, also if no batch holds it twice."""
    shared = " ".join(f"menu{j}" for j in range(10))
    rows = [(i, f"https://h.example/{i}", f"<p>page{i} own{i}</p><p>{shared if i % 7 == 0 else f'x{i}'}</p>") for i in range(40)]
    out = {r["page_id"]: r["text"] for r in html_text.extract_main_text(_pages(spark, rows), batch_pages=batch_pages).collect()}
    assert out == {i: f"page{i} own{i}" + ("" if i % 7 == 0 else f" x{i}") for i in range(40)}


def test_pages_without_articles_against_brute_force(spark):
    """The real pages with their article elements taken for plain ones: what five distinct pages of a host share in eight tokens goes."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    plain = [re.sub("</?article>|</?nav>|</?footer>|class=\"ad\"", "", h or "") for h in pages["html"]]
    hosts = pages["url"].str.extract("://([^/?#]*)")[0]
    streams = [" ".join(t for _, t in html_text.page_blocks(h)).split(" ") for h in plain]
    seen = {}
    for host, s in zip(hosts, streams, strict=True):
        for i in range(len(s) - 7):
            seen.setdefault((host, *s[i : i + 8]), set()).add(tuple(s))
    expected = {}
    for page_id, host, s in zip(pages["page_id"], hosts, streams, strict=True):
        gone = {i + k for i in range(len(s) - 7) if len(seen[(host, *s[i : i + 8])]) >= 5 for k in range(8)}
        expected[page_id] = " ".join(t for i, t in enumerate(s) if i not in gone)
    rows = list(zip(pages["page_id"].tolist(), pages["url"].tolist(), plain, strict=True))
    out = {r["page_id"]: r["text"] for r in html_text.extract_main_text(_pages(spark, rows)).collect()}
    assert out == expected


def test_repeated_runs_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        streams = [rng.integers(0, 3, rng.integers(0, 40)).astype(np.uint64) for _ in range(6)]
        pages = {}
        for k, s in enumerate(streams):
            for i in range(len(s) - 3):
                pages.setdefault(tuple(s[i : i + 4].tolist()), set()).add(k)
        expected = {int(html_text.run_hashes(np.array(w, np.uint64), 4)[0]): len(p) for w, p in pages.items() if len(p) > 1}
        hashes, counts = html_text.repeated_runs(streams, 4)
        assert dict(zip(hashes.tolist(), counts.tolist(), strict=True)) == expected
        known = np.sort(hashes)
        for s in streams:
            cover = np.zeros(len(s), bool)
            for i in range(len(s) - 3):
                if len(pages[tuple(s[i : i + 4].tolist())]) > 1:
                    cover[i : i + 4] = True
            assert (html_text.covered(s, known, 4) == cover).all()


def test_pages_of_odd_rows(spark):
    """Null in every column, empty and very long html, repeated rows, and columns whose names clash."""
    long = "<article>" + "<p>a word</p>" * 100_000 + "</article>"
    rows = [(1, "u", "<p>one</p>"), (1, "u", "<p>one</p>"), (1, None, "<p>other</p>"), (None, None, None), (2, "http://h/", ""), (3, "http://h/", long), (2**60 + 1, "http://h/x", "<p>far</p>")]
    names = "host string, salt int, run long, number long, page string, text string, outside string, identity long, n long"
    pages = spark.createDataFrame([(*r, *[None] * 9) for r in rows], f"page_id long, url string, html string, {names}")
    out = Counter(tuple(r) for r in html_text.extract_main_text(pages).collect())
    whole = " ".join(["a word"] * 100_000)
    assert out == Counter({(1, "u", "one", 3): 2, (1, None, "other", 5): 1, (None, None, "", 0): 1, (2, "http://h/", "", 0): 1, (3, "http://h/", whole, len(whole)): 1, (2**60 + 1, "http://h/x", "far", 3): 1})
    assert html_text.extract_main_text(pages.limit(0)).count() == 0
