"""Queries of linkage and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lintel.functions import lexicon, text
from lintel.operators import evaluate, linkage, selection
from lintel.operators.runs import first_of_each, top_of_each, upsert
from lintel.operators.shared import written
from lintel.plans.tables import distinct, fixture, forms, forms_sql, literal, norm, table, values_sql, words

STOP = lexicon.STOPWORDS
PER_QUERY = 5
QUERIES_PER_ITEM = 12


def _tokens(docs):
    """Documents as words, written once: their n-grams and their word sets read them again."""
    return written(docs.select("doc_id", text.words(text.normalize_long(F.col("text"))).alias("tokens")))


def _item_queries(items):
    grams = linkage.ngrams(F.col("tokens"), 4, 4)
    return items.select("item_id", F.posexplode(F.slice(F.array_distinct(grams), 1, QUERIES_PER_ITEM)).alias("qpos", "query"))


def _links(spark, sf_dir, docs=None, held=None, keep=False):
    """Ranked documents of every benchmark item that one of its queries finds. docs: words of all documents, held: 4-grams that they hold, if known."""
    items = table(spark, sf_dir, "benchmark").select("item_id", text.words(text.normalize(F.col("text"))).alias("tokens"))
    docs = docs if docs is not None else _tokens(table(spark, sf_dir, "documents"))
    queries = _item_queries(items)
    # only the 4-grams that some item asks for go on from the documents
    index = linkage.held_grams(docs, queries) if held is None else held.join(queries.select("query").distinct(), "query", "left_semi")
    hits = queries.join(top_of_each(index, ["query"], PER_QUERY, "doc_id"), "query")
    # written: the planner knows that few documents are found, and shuffles not all of them to meet those
    found = written(hits.groupBy("item_id", "doc_id").agg(F.count_distinct("query").alias("n_queries"), F.min("qpos").alias("first_seen")))
    joined = docs.select("doc_id", F.col("tokens").alias("have")).join(found, "doc_id").join(items.select("item_id", F.array_distinct("tokens").alias("want")), "item_id")
    scored = joined.select("item_id", "doc_id", "n_queries", "first_seen", F.round(text.overlap(F.col("want"), F.col("have")), 9).alias("score"))
    order = [F.col("score").desc(), F.col("n_queries").desc(), "first_seen", "doc_id"]
    scored = written(scored) if keep else scored
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))


_LINKS = f"""
    i AS (SELECT item_id, {words('text')} AS t FROM benchmark),
    d AS (SELECT doc_id, {words('text')} AS t FROM documents),
    g AS (SELECT item_id, t[k] || ' ' || t[k+1] || ' ' || t[k+2] || ' ' || t[k+3] AS query, k FROM i, unnest(range(1, len(t) - 2)) AS r(k)),
    q AS (SELECT item_id, query, row_number() OVER (PARTITION BY item_id ORDER BY k) - 1 AS qpos
          FROM (SELECT item_id, query, min(k) AS k FROM g GROUP BY ALL) QUALIFY qpos < {QUERIES_PER_ITEM}),
    x AS (SELECT DISTINCT doc_id, t[k] || ' ' || t[k+1] || ' ' || t[k+2] || ' ' || t[k+3] AS query FROM d, unnest(range(1, len(t) - 2)) AS r(k)),
    h AS (SELECT * FROM x WHERE query IN (SELECT query FROM q) QUALIFY row_number() OVER (PARTITION BY query ORDER BY doc_id) <= {PER_QUERY}),
    f AS (SELECT item_id, doc_id, count(DISTINCT query) AS n_queries, min(qpos) AS first_seen FROM q JOIN h USING (query) GROUP BY ALL),
    s AS (SELECT item_id, doc_id, n_queries, first_seen,
                 round(len(list_filter(list_distinct(i.t), lambda w: list_contains(d.t, w))) / len(list_distinct(i.t)), 9) AS score
          FROM f JOIN i USING (item_id) JOIN d USING (doc_id)),
    l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, n_queries DESC, first_seen, doc_id) AS rank FROM s)"""


def candidate_search(spark, sf_dir):
    return _links(spark, sf_dir)


#: Starts without a whole word inside that are looked for in all documents at a time.
STARTS_AT_ONCE = 500


def _truths(items, docs, tokens, more=None):
    """item_id and doc_id of every document that contains an item's start, whatever the search proposes.

    A document that contains the start holds its words but the first and the last, which may be parts of
    longer ones: those that hold the rarest run of up to four of them are compared. Runs of a length that
    no item asks for are not formed. ``tokens`` holds the documents' words. Also gives what they hold: of those runs, and of
    ``more`` 4-grams (query), which are looked up with them.
    """
    words = items.select("item_id", "start", text.words(text.normalize(F.col("start"))).alias("words"))
    inner = written(words.select("item_id", "start", F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0))).alias("inner")))
    runs = F.when(F.size("inner") < 4, F.array(F.array_join("inner", " "))).otherwise(linkage.ngrams(F.col("inner"), 4, 4))
    asked = inner.where(F.size("inner") > 0).select("item_id", F.explode(F.array_distinct(runs)).alias("run"))
    lengths = [r[0] for r in inner.where(F.size("inner") > 0).select(F.least(F.size("inner"), F.lit(4))).distinct().collect()]  # four at most
    queries = asked.select(F.col("run").alias("query"))
    grams, sizes = (queries, lengths) if more is None else (queries.unionAll(more.select("query")), [*lengths, 4])
    every = written(linkage.held_grams(tokens, grams, sizes or [4]))
    held = every.withColumnRenamed("query", "run")
    counted = asked.join(held.groupBy("run").agg(F.count(F.lit(1)).alias("n")), "run", "left").fillna(0, ["n"])
    rarest = first_of_each(counted, ["item_id"], "n", "run").select("item_id", "run")
    met = written(rarest.join(held, "run").select("item_id", "doc_id").distinct())  # known to be few: the texts stay where they are
    found = docs.join(met, "doc_id").join(items, "item_id").where(F.contains("text", F.col("start"))).select("item_id", "doc_id")
    # a start of two words at most has no whole word inside: it is looked for everywhere, so many starts at a time
    short = inner.where("start <> '' AND size(inner) = 0").select("item_id", "start")
    n = short.count()
    numbered = short.withColumn("_nth", F.row_number().over(Window.orderBy("item_id"))) if n else short
    for k in range(-(-n // STARTS_AT_ONCE)):
        some = F.broadcast(numbered.where(F.floor((F.col("_nth") - 1) / STARTS_AT_ONCE) == k))
        found = found.unionAll(docs.join(some, F.contains("text", F.col("start"))).select("item_id", "doc_id"))
    return found, every


def _searched(spark, sf_dir, ends=False):
    """The links that the search finds, all pairs of an item and a document that contains its start (or, with ends, its end), all 4-grams
    of items, and those (with ends; else those of queries) that documents hold. Documents are looked through once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = _tokens(docs)
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 2).alias("item_id"), F.substring("text", 1, 60).alias("start"), F.substring("text", -60, 60).alias("end"))
    pieces = items.select("item_id", "start")
    if ends:
        pieces = pieces.unionAll(items.select(F.col("item_id") + 1, "end"))
    known = table(spark, sf_dir, "benchmark").select("item_id", text.words(text.normalize(F.col("text"))).alias("tokens"))
    grams = known.select("item_id", F.posexplode(F.array_distinct(linkage.ngrams(F.col("tokens"), 4, 4))).alias("qpos", "query"))
    found, held = _truths(pieces, docs, tokens, grams if ends else grams.where(F.col("qpos") < QUERIES_PER_ITEM))
    pairs = found.select(F.floor(F.col("item_id") / 2).alias("item_id"), "doc_id").distinct()
    return _links(spark, sf_dir, tokens, held, keep=True), written(pairs), grams, held


def _benchmark_results(spark, sf_dir):
    links, pairs, _, _ = _searched(spark, sf_dir)
    links = links.select(F.col("item_id").alias("album_id"), F.col("doc_id").alias("id"), "rank", "score")
    truth = pairs.groupBy(F.col("item_id").alias("album_id")).agg(F.min("doc_id").alias("truth_id"))
    auto = links.where("rank = 1 AND score >= 0.85").select("album_id", "id")
    return evaluate.truth_ranks(links, truth, auto)


def eval_recall(spark, sf_dir):
    """What the search proposes of all pairs of an item and a document that contains its start or its end: with the search's limits,
    without that on the documents of a query, and without that on queries."""
    links, pairs, every, held = _searched(spark, sf_dir, ends=True)
    shared = pairs.join(every, "item_id").join(held, ["doc_id", "query"]).groupBy("item_id", "doc_id").agg(F.min("qpos").alias("qpos"))
    return evaluate.recall_by_limits(pairs, links.select("item_id", "doc_id", "rank"), shared, QUERIES_PER_ITEM)


def eval_metrics(spark, sf_dir):
    measured = evaluate.gates(evaluate.metrics(_benchmark_results(spark, sf_dir)), 0.9, 0.5)
    return measured.select("n", "regressions", "lost", "passes", *[F.round(c, 9).alias(c) for c in measured.columns if c not in ("n", "regressions", "lost", "passes")])


def eval_regressions(spark, sf_dir):
    rows = _benchmark_results(spark, sf_dir)
    return rows.select("album_id", "truth_id", "rank", "top_id", F.when(F.col("rank") > 0, F.col("rank")).otherwise(9999).alias("order_key"), (F.col("rank") > 1).alias("is_regression"))


_RESULTS = f"""WITH {_LINKS},
    t AS (SELECT item_id, min(doc_id) AS truth_id FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 60)) WHERE b.text <> '' GROUP BY 1),
    r AS (SELECT t.item_id, t.truth_id, coalesce(l.rank, 0) AS rank, l.score, p.doc_id AS top_id, CASE WHEN p.score >= 0.85 THEN p.doc_id END AS auto_id
          FROM t LEFT JOIN l ON t.item_id = l.item_id AND t.truth_id = l.doc_id LEFT JOIN l p ON p.item_id = t.item_id AND p.rank = 1)"""


def title_ngrams(spark, sf_dir):
    albums = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("album_id"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        *[F.array().cast("array<string>").alias(c) for c in ("works", "composers", "performers", "ensembles", "instruments")],
        F.lit(None).cast("string").alias("conductor"),
        F.lit(None).cast("string").alias("label"),
    )
    return linkage.query_candidates(albums).select("album_id", "template", "query")


ALBUMS = [
    ("a1", "Goldberg Variations {w}", ["BWV 988"], ["Bach"], ["Glenn Gould"], [], "", ["pf"], "Sony Classical", "1981"),
    ("a2", "Symphonies", ["Symphony No 5", "Symphony No 7"], ["Beethoven"], [], ["Berlin Philharmonic"], "Carlos Kleiber", [], "DG", "2025"),
    ("a3", "Piano Works", [], ["Ravel", "{w}"], ["Martha Argerich"], [], "", ["piano"], "", ""),
    ("a4", "", [], [], [], [], "", [], "", ""),
    ("a5", "Mahler 2 and 4", ["Symphonies 2, 4 {n}"], ["Mahler"], ["Anna Prohaska", "Lee"], ["LSO"], "Simon Rattle", [], "LSO Live", "2025"),
]
HITS = [
    ("h1", "Bach: Goldberg Variations, BWV 988", ["Glenn Gould"], "1981-09-01", "(P) 1982 Sony Classical"),
    ("h2", "Beethoven: Symphonies 5 & 7", ["Vienna Philharmonic", "Carlos Kleiber"], "2025-01-10", "DG"),
    ("h3", "Piano Works", ["Someone Else"], "2020", ""),
    ("h4", "Mahler 4", ["London Symphony Orchestra"], "2025-05-05", "LSO Live"),
    ("h5", "Ravel & Debussy", ["Martha Argerich"], "2025-02-02", ""),
    ("h6", "Café music 1–5", [], "", ""),
]


def _albums(spark, sf_dir):
    """Each document as one of the albums."""
    return forms(spark, sf_dir, linkage.ALBUM, ALBUMS).withColumn("album_id", F.concat_ws("-", "album_id", F.col("pos").cast("string"))).drop("pos")


def _pairs(spark, sf_dir):
    """Each document as one of the albums, with all hits."""
    return linkage.album_features(_albums(spark, sf_dir)).crossJoin(F.broadcast(linkage.hit_features(fixture(spark, linkage.HIT, HITS))))


def score_penalized(spark, sf_dir):
    scored = linkage.scores(linkage.features(_pairs(spark, sf_dir)))
    return scored.select("album_id", "id", *[F.round(f"{f}_score", 9).alias(f) for f in linkage.FEATURES], F.round("base", 9).alias("base"), F.round("score", 9).alias("score"))


def auto_gate(spark, sf_dir):
    scored = linkage.scores(linkage.features(_pairs(spark, sf_dir))).withColumn("queries", F.array("id")).withColumn("first_seen", F.col("id"))
    return linkage.automatic_choice(linkage.ranked(scored).where("rank = 1"), 0.7, 2025, 0.2)


def query_selection(spark, sf_dir):
    return linkage.select_album_queries(linkage.album_queries(_albums(spark, sf_dir)), 12)


def _set(x: str, least: int = 3) -> str:
    return f"list_distinct(flatten(list_transform({x}, lambda v: {words('v', least, STOP)})))"


def _artist(x: str) -> str:
    return f"list_filter({_set(x)}, lambda w: NOT list_contains({literal(lexicon.GENERIC_ARTIST_TOKENS)}, w))"


def _over(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_filter({a}, lambda w: list_contains({b}, w))) / len({a}) END)"


def _phrase(a: str, b: str) -> str:
    held = f"list_filter(list_transform({a}, lambda v: {norm('v')}), lambda v: v <> '')"
    other = f"list_filter(list_transform({b}, lambda v: {norm('v')}), lambda v: v <> '')"
    return f"(CASE WHEN len({held}) = 0 THEN 0.0 ELSE len(list_filter({held}, lambda v: len(list_filter({other}, lambda o: contains(v, o) OR contains(o, v))) > 0)) / len({held}) END)"


def _numbers(x: str) -> str:
    return f"list_distinct(flatten(list_transform({x}, lambda v: regexp_extract_all(lower(regexp_replace(strip_accents(v), '[^\\x00-\\x7F]', '', 'g')), '\\b\\d+\\b'))))"


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lexicon.INSTRUMENTS.items()) + "}"
_SKIPPED = literal(sorted({*lexicon.GENERIC_LINE_PREFIXES, *lexicon.SKIPPED_SEGMENTS}))
_W = lexicon.FEATURE_WEIGHTS
_SCORED = f"""
    c AS (SELECT *, list_concat([title], works) AS titles, [conductor] AS leader FROM (SELECT album_id || '-' || pos AS album_id, * EXCLUDE (pos, album_id) FROM {forms_sql(linkage.ALBUM, ALBUMS)}), {values_sql(linkage.HIT, HITS)}),
    k AS (SELECT *, {_set('titles')} AS k_title, {_set('composers')} AS k_composer, {_artist('performers')} AS k_performer, {_artist('ensembles')} AS k_ensemble,
                 {_artist('leader')} AS k_conductor,
                 list_distinct(list_transform(list_filter(flatten(list_transform(instruments, lambda v: {words('v')})), lambda w: NOT list_contains({_SKIPPED}, w)), lambda w: coalesce({_MAP}[w], w))) AS k_instrument,
                 {_set('[hit_title]')} AS g_title, {_artist('artists')} AS g_artist, {norm('label')} AS n_label, {norm('copyright')} AS n_copy, {norm('title')} AS n_a, {norm('hit_title')} AS n_b,
                 {_numbers('titles')} AS asked, {_numbers('[hit_title]')} AS got FROM c),
    e AS (SELECT *, list_distinct(list_concat(g_title, g_artist)) AS g_all FROM k),
    f AS (SELECT *, CASE WHEN n_a <> '' AND n_b <> '' AND (contains(n_b, n_a) OR contains(n_a, n_b)) THEN greatest({_over('k_title', 'g_title')}, 0.95) ELSE {_over('k_title', 'g_title')} END AS s_title,
                 greatest({_phrase('composers', 'list_concat([hit_title], artists)')}, {_over('k_composer', 'g_all')} * 0.6) AS s_composer,
                 greatest({_phrase('performers', 'artists')}, {_over('k_performer', 'g_all')} * 0.6) AS s_performer,
                 greatest({_phrase('ensembles', 'artists')}, {_over('k_ensemble', 'g_all')}) AS s_ensemble,
                 greatest({_phrase('leader', 'artists')}, {_over('k_conductor', 'g_all')} * 0.6) AS s_conductor,
                 {_over('k_instrument', 'g_title')} AS s_instrument,
                 CASE WHEN length(n_label) > 2 AND contains(n_copy, n_label) THEN 1.0 ELSE 0.0 END AS s_label,
                 CASE WHEN regexp_extract(year, '\\b(?:19|20)\\d{{2}}\\b') <> '' AND regexp_extract(year, '\\b(?:19|20)\\d{{2}}\\b') = regexp_extract(release_date, '\\b(?:19|20)\\d{{2}}\\b') THEN 1.0 ELSE 0.0 END AS s_year FROM e),
    b AS (SELECT *, CAST({' + '.join(f's_{n} * {w}' for n, w in _W.items())} AS DOUBLE) AS base, greatest(s_performer, s_ensemble, s_conductor) AS sup,
                 len(k_performer) > 0 OR len(k_ensemble) > 0 OR len(k_conductor) > 0 AS asks, len(k_composer) > 0 AND s_composer = 0 AS noc,
                 len(k_title) > 0 AND len(list_filter(k_title, lambda w: NOT list_contains({literal(lexicon.GENERIC_TITLE_TOKENS)}, w))) = 0 AS gen,
                 len(asked) > 0 AND len(got) > 0 AS num FROM f),
    p AS (SELECT *, base * (CASE WHEN asks AND sup = 0 THEN 0.45 WHEN asks AND sup < 0.34 THEN 0.7 ELSE 1 END)
                        * (CASE WHEN noc AND sup = 0 THEN 0.8 WHEN noc AND gen THEN 0.55 ELSE 1 END)
                        * (CASE WHEN n_label <> '' AND s_label = 0 AND sup = 0 THEN 0.85 ELSE 1 END)
                        * (CASE WHEN num AND len(list_intersect(asked, got)) = 0 THEN 0.55 WHEN num AND len(asked) > 1 AND len(list_filter(asked, lambda w: NOT list_contains(got, w))) > 0 THEN 0.8 ELSE 1 END) AS score FROM b)"""


def status_summary(spark, sf_dir):
    return evaluate.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


def top_counts(spark, sf_dir):
    """The five most frequent users and the type of their first event; ties by first sighting."""
    return selection.most_frequent(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


def ordered_distinct(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return first_of_each(part.select("p_partkey", "p_brand", "p_type"), ["p_brand"], "p_partkey")


def fingerprint_dedupe(spark, sf_dir):
    """The first document of each language and SHA-256 of the whole normalised text."""
    return selection.first_texts(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["lang"], "text", "doc_id", "start")


def weight_ema(spark, sf_dir):
    weights = fixture(spark, "feature string, weight double", [(t, 0.1 * k) for k, t in enumerate(["signup", "purchase", "error", "view", "missing"])])
    sums = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("feature")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return linkage.ema_weights(weights, sums).select("feature", F.round("weight", 6).alias("weight"))


def template_weight_update(spark, sf_dir):
    weights = fixture(spark, "template string, weight double", [("signup", 1.0), ("purchase", 1.4), ("idle", 0.9)])
    stats = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("template")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("value") > 50).alias("hits"))
    return linkage.template_weights(weights, stats).select("template", F.round("weight", 9).alias("weight"))


def upsert_records(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_orderkey").alias("pos"))
    new = orders.where("id % 7 = 0").select((F.col("id") + F.when(F.col("id") % 2 == 0, 1_000_000).otherwise(0)).alias("id"), F.lit("N").alias("o_orderstatus"), "pos")
    return upsert(orders, new, "id", "pos")


def resume_filter(spark, sf_dir):
    """Rows of a range whose record is not labelled yet."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey BETWEEN 100 AND 5000")
    done = table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'P')").select("o_orderkey")
    return selection.not_done(orders, done, "o_orderkey").select("o_orderkey", "o_totalprice")


def selected_ids(spark, sf_dir):
    """Distinct chosen ids by first sighting, and the records that have none."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return selection.standing_choices(orders, "o_custkey", "o_orderkey", F.col("o_orderstatus") != "P")


QUERIES = {
    f.__name__: f
    for f in (
        candidate_search, eval_metrics, eval_regressions, eval_recall, title_ngrams, score_penalized, auto_gate, query_selection, status_summary, top_counts,
        ordered_distinct, fingerprint_dedupe, weight_ema, template_weight_update, upsert_records, resume_filter, selected_ids,
    )
}

ORACLES = {
    "candidate_search": f"WITH {_LINKS} SELECT item_id, doc_id, n_queries, first_seen, score, rank FROM l",
    "eval_recall": f"""WITH {_LINKS},
        t AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 60)) OR contains(d.text, right(b.text, 60)) WHERE b.text <> ''),
        a AS (SELECT item_id, query, row_number() OVER (PARTITION BY item_id ORDER BY k) - 1 AS qpos FROM (SELECT item_id, query, min(k) AS k FROM g GROUP BY ALL)),
        m AS (SELECT t.item_id, t.doc_id, min(qpos) AS qpos FROM t JOIN a USING (item_id) JOIN x ON x.doc_id = t.doc_id AND x.query = a.query GROUP BY ALL),
        r AS (SELECT t.*, l.rank, m.qpos FROM t LEFT JOIN l USING (item_id, doc_id) LEFT JOIN m USING (item_id, doc_id))
        SELECT count(DISTINCT item_id) AS items, count(*) AS pairs, count(rank) AS found, count(*) - count(rank) AS lost, count(*) FILTER (rank <= 5) AS in_first_5, round(count(rank) / count(*), 9) AS recall,
               round(count(*) FILTER (qpos < {QUERIES_PER_ITEM}) / count(*), 9) AS recall_all_documents, round(count(qpos) / count(*), 9) AS recall_all_queries FROM r""",
    "eval_metrics": f"""{_RESULTS}
        SELECT count(*) AS n, round(coalesce(avg(CAST(coalesce(top_id = truth_id, false) AS INT)), 0), 9) AS precision_at_1, round(coalesce(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END), 0), 9) AS mrr,
               round(coalesce(avg(CAST(auto_id IS NOT NULL AS INT)), 0), 9) AS auto_coverage,
               round(coalesce(sum(CAST(auto_id = truth_id AS INT)) / nullif(count(auto_id), 0), 0), 9) AS auto_accuracy,
               round(coalesce(sum(CAST(auto_id = truth_id AS INT)) / nullif(count(*), 0), 0), 9) AS auto_recall,
               coalesce(round(min(score), 9), 0) AS score_min, coalesce(round(median(score), 9), 0) AS score_median, coalesce(round(avg(score), 9), 0) AS score_mean,
               coalesce(round(max(score), 9), 0) AS score_max, count(*) FILTER (rank > 0 AND top_id IS DISTINCT FROM truth_id) AS regressions, count(*) FILTER (rank = 0) AS lost,
               coalesce(avg(CAST(coalesce(top_id = truth_id, false) AS INT)), 0) >= 0.9 AND coalesce(sum(CAST(auto_id = truth_id AS INT)) / nullif(count(*), 0), 0) >= 0.5 AS passes FROM r""",
    "eval_regressions": f"{_RESULTS} SELECT item_id AS album_id, truth_id, rank, top_id, CASE WHEN rank > 0 THEN rank ELSE 9999 END AS order_key, rank > 1 AS is_regression FROM r",
    "title_ngrams": f"""
        WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS title, {words("p_name || ' ' || p_type", 2, STOP)} AS t FROM part),
             q AS (SELECT p_partkey, 0 AS pos, 'title' AS template, title AS query FROM p
                   UNION ALL SELECT p_partkey, 1, 'title_short', array_to_string(t[1:4], ' ') FROM p
                   UNION ALL SELECT p_partkey, 2, 'title_reversed', array_to_string(list_reverse(t), ' ') FROM p WHERE len(t) > 1
                   UNION ALL SELECT p_partkey, 3, 'title_sorted', array_to_string(list_sort(t), ' ') FROM p WHERE len(t) > 1
                   UNION ALL SELECT p_partkey, 100 * n + k, 'title_ngrams', array_to_string(t[k:k + n - 1], ' ') FROM p, range(2, 5) AS a(n), unnest(range(1, len(t) - n + 2)) AS b(k))
        SELECT CAST(p_partkey AS VARCHAR) AS album_id, template, query FROM q WHERE query <> '' QUALIFY row_number() OVER (PARTITION BY p_partkey, lower(query) ORDER BY pos) = 1""",
    "score_penalized": f"WITH {_SCORED} SELECT album_id, id, {', '.join(f'round(CAST(s_{n} AS DOUBLE), 9) AS {n}' for n in _W)}, round(base, 9) AS base, round(score, 9) AS score FROM p",
    "auto_gate": f"""WITH {_SCORED}, t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY album_id ORDER BY score DESC, lower(hit_title) DESC, id) = 1),
        g AS (SELECT *, CASE WHEN score >= 0.7 THEN 'score>=0.70'
                WHEN regexp_extract(release_date, '\\b(?:19|20)\\d{{2}}\\b') = '2025' AND score > 0.2 AND s_title >= 0.25 THEN 'release_year==2025 and score>0.20'
                WHEN regexp_extract(release_date, '\\b(?:19|20)\\d{{2}}\\b') = '2025' AND score > 0.2 AND sup >= 0.75 AND s_label >= 1 THEN 'release_year==2025 and score>0.20 with strong artist+label match'
                ELSE '' END AS reason FROM t)
        SELECT album_id, CASE WHEN reason <> '' THEN id END AS id, reason FROM g""",
    "status_summary": "SELECT " + ", ".join(f"count(*) FILTER (o_orderstatus = '{k}') AS {q}" for k, q in zip("FOPX", ['"F"', '"O"', '"P"', '"X"'], strict=True)) + " FROM orders",
    "top_counts": """WITH c AS (SELECT user_id, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1 ORDER BY n DESC, f LIMIT 5)
        SELECT c.user_id, n, event_type FROM c JOIN events e ON e.event_id = f""",
    "ordered_distinct": "SELECT p_partkey, p_brand, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1",
    "fingerprint_dedupe": f"WITH n AS (SELECT doc_id, lang, sha256({norm('text')}) AS start FROM documents) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY lang, start ORDER BY doc_id) = 1",
    "weight_ema": """WITH w AS (SELECT * FROM (VALUES ('signup', 0.0), ('purchase', 0.1), ('error', 0.2), ('view', 0.3), ('missing', 0.4)) AS t(feature, weight)),
        s AS (SELECT event_type AS feature, avg(value) AS m FROM events GROUP BY 1)
        SELECT feature, round(CAST(CASE WHEN m IS NULL THEN weight ELSE 0.7 * weight + 0.3 * m END AS DOUBLE), 6) AS weight FROM w LEFT JOIN s USING (feature)""",
    "template_weight_update": """WITH w AS (SELECT * FROM (VALUES ('signup', 1.0), ('purchase', 1.4), ('idle', 0.9)) AS t(template, weight)),
        s AS (SELECT event_type AS template, count(*) AS a, count(*) FILTER (value > 50) AS h FROM events GROUP BY 1)
        SELECT template, round(CAST(CASE WHEN a > 0 THEN coalesce(weight, 0.5) * (0.5 + h / a) ELSE weight END AS DOUBLE), 9) AS weight FROM w FULL JOIN s USING (template)""",
    "upsert_records": """WITH o AS (SELECT o_orderkey AS id, o_orderstatus, o_orderkey AS pos FROM orders),
        n AS (SELECT id + CASE WHEN id % 2 = 0 THEN 1000000 ELSE 0 END AS id, 'N' AS o_orderstatus, pos FROM o WHERE id % 7 = 0)
        SELECT coalesce(n.id, o.id) AS id, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus,
               row_number() OVER (ORDER BY o.pos NULLS LAST, n.pos NULLS LAST, coalesce(n.id, o.id)) AS pos FROM o FULL JOIN n ON o.id = n.id""",
    "resume_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 5000 AND o_orderstatus NOT IN ('F', 'P')",
    "selected_ids": """SELECT o_custkey, min(o_orderkey) AS o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS unmatched
        FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
}
