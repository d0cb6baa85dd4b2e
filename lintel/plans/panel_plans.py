"""Queries over rates, panels and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.functions import values
from lintel.operators import panel, transcript
from lintel.operators.runs import side_by_side, with_appearance
from lintel.plans.tables import fixture, forms, forms_sql, table, values_sql

SYMBOLS = ["lse:A{n}:gbx", "ABC", " x : EUR ", "a:b:toolong", "", None, "NYSE:IBM:usd"]
PERCENTS = ["+1.{n}%", "-{n}%", "1,234.5%", "−3.25%", "n/a", "", None, "12", "%", "0.10 %"]
LABELS = ["YTD", "1 month", "3 months", "1 year", "5 years annualised", "since launch"]
AS_OF_TEXTS = ["prices as of Jan 5 2024 close", "As of Feb 29, 2024", "as of Foo 1 2024", "none", None]
SECONDS = [0.0, 1.2345, 61.0, 3661.005, 359999.9996, -4.0, 0.0005, 0.0015]
RATES = [("2024-01-01", "USD", 1.10), ("2024-01-01", "GBP", 0.86), ("2024-01-05", "USD", 1.08), ("2024-02-01", "GBP", 0.85), ("2023-01-02", "USD", 1.05), ("2023-12-29", "USD", 1.12), ("2023-12-29", "GBP", 0.87), ("2022-12-30", "GBP", 0.88)]
PANEL = [("f1", "Fund", "2024-02-03", "USD", "GBP", "+1.{n}%", "-2.{n}%", "10%"), ("f2", "Index", "2024-01-31", "GBP", "GBP", "3%", "n/a", ""), ("f3", "Old", "2022-01-01", "USD", "GBP", "1%", "2%", "3%"), ("f4", "None", "2024-01-31", "", "GBP", "1%", "-", "5%")]
PERIODS = ["ytd", "1 month", "1 year"]
_PANEL_COLUMNS = "symbol string, row_label string, as_of date, base string, target string, ytd string, 1_month string, 1_year string"


def currency_rules(spark, sf_dir):
    s = F.col("symbol")
    return forms(spark, sf_dir, "symbol string", [(x,) for x in SYMBOLS]).select("pos", values.currency(s).alias("code"), values.target_currency(s).alias("target"), values.symbol_with(s, ":EUR").alias("full"), values.blank(s).alias("blank"))


def parse_percent(spark, sf_dir):
    return forms(spark, sf_dir, "cell string", [(x,) for x in PERCENTS]).select("pos", F.round(values.percent(F.col("cell")), 9).alias("fraction"))


def percent_of_lines(spark, sf_dir):
    shown = F.concat(F.lit("+"), F.format_number(F.col("l_discount") * 100000, 1), F.lit("%"))
    return table(spark, sf_dir, "lineitem").groupBy("l_discount").agg(F.count(F.lit(1)).alias("n")).select("l_discount", "n", F.round(values.percent(shown), 6).alias("fraction"))


def as_of_text(spark, sf_dir):
    return forms(spark, sf_dir, "text string", [(x,) for x in AS_OF_TEXTS]).select("pos", values.as_of_date(F.col("text")).alias("as_of"))


def period_start(spark, sf_dir):
    dates = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    labels = fixture(spark, "label string", [(x,) for x in LABELS])
    return dates.crossJoin(F.broadcast(labels)).select("day", "label", values.period_start(F.col("day"), F.col("label")).alias("start"))  # a few labels


def asof_rate(spark, sf_dir):
    """The value of the last view at or before each purchase of the same user."""
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", "event_id", F.col("value").alias("rate"))
    probes = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return panel.as_of(probes, views, ["user_id"], "ts", "ts", "rate", order="event_id").select("event_id", "rate")


def period_return(spark, sf_dir):
    """Change of a customer segment's mean order value from 3 months before to each quarter's last known day."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rates = orders.groupBy(F.to_date("o_orderdate").alias("rate_date"), F.col("c_mktsegment").alias("currency")).agg(F.round(F.avg("o_totalprice"), 6).alias("rate"))
    ends = rates.groupBy("currency", F.date_trunc("quarter", F.col("rate_date")).alias("q")).agg(F.max("rate_date").alias("day")).drop("q")
    probes = ends.withColumn("start", values.period_start(F.col("day"), F.lit("3 months")))
    last = panel.as_of(probes, rates, ["currency"], "day", "rate_date", "rate").withColumnRenamed("rate", "rate_end")
    both = panel.as_of(last, rates, ["currency"], "start", "rate_date", "rate")
    return both.select("currency", "day", F.round(F.col("rate_end") / F.col("rate") - 1, 9).alias("period_return"))


def panel_adjust(spark, sf_dir):
    made = forms(spark, sf_dir, _PANEL_COLUMNS, PANEL).withColumn("symbol", F.concat_ws("-", "symbol", F.col("pos").cast("string"))).drop("pos")
    rows = made.withColumnsRenamed({"1_month": "1 month", "1_year": "1 year"})
    rates = fixture(spark, "rate_date date, currency string, rate double", RATES)
    out = panel.adjusted_panel(rows, rates, PERIODS, "as_of", "base", "target")
    return out.select("symbol", *[F.round(F.col(f"`{p}`"), 9).alias(p.replace(" ", "_")) for p in PERIODS], "applied")


def frame_union(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("x").alias("kind"))
    header = fixture(spark, "name string, region string", [("name", "region")])
    return panel.without_header_rows(panel.stacked([nation, region, header, nation]), ["name", "region"])


def positional_concat(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return side_by_side(nation, region, "n_nationkey", "r_regionkey").select("row_no", "n_name", "r_name")


def _seconds(spark, sf_dir):
    made = forms(spark, sf_dir, "seconds double", [(x,) for x in SECONDS])
    return made.withColumn("seconds", F.col("seconds") + F.col("pos") % 1000 * 0.5)


def time_formats(spark, sf_dir):
    s = F.col("seconds")
    return _seconds(spark, sf_dir).select("pos", values.subtitle_time(s).alias("srt"), values.subtitle_time(s, ".").alias("vtt"), values.duration(s).alias("shown"), F.round(values.clock_seconds(values.subtitle_time(s, ".")), 3).alias("back"))


def _segments(spark, sf_dir):
    """Conversations as segments: a text takes a second for every 15 characters."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seg_no"), F.col("role").alias("speaker"), "text")
    whole = Window.partitionBy("conv_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(whole) / F.lit(15.0)
    return turns.withColumn("end", end).withColumn("start", F.col("end") - F.length("text") / F.lit(15.0))


def speaker_relabel(spark, sf_dir):
    rows = with_appearance(_segments(spark, sf_dir), ["conv_id"], "speaker", "seg_no")
    return rows.select("conv_id", "seg_no", F.col("label_no").cast("long").alias("label_no"))


def overlap_attribution(spark, sf_dir):
    """Half-hour segments of a user's events and the day quarter that overlaps each longest."""
    events = table(spark, sf_dir, "events")
    t = F.unix_micros(F.to_timestamp("ts")) / 1e6
    segments = events.select("user_id", F.col("event_id").alias("seg_no"), t.alias("start"), (t + 60 + F.col("event_id") % 30_000).alias("end"))
    turns = events.where("event_type IN ('view', 'click')").select("user_id", F.col("event_id").alias("turn_no"), (t - 7200).alias("start"), (t + 7200).alias("end"), F.concat(F.col("event_type"), F.lit("-"), (F.col("event_id") % 3).cast("string")).alias("speaker"))
    return transcript.attributed(segments, turns, ["user_id"]).select("user_id", "seg_no", "speaker", "label")


def _emitter(style):
    def query(spark, sf_dir):
        return transcript.transcript_in(_segments(spark, sf_dir), ["conv_id"], style)

    return query


emit_txt = _emitter("txt")
emit_srt = _emitter("srt")
emit_vtt = _emitter("vtt")
diarized_txt = _emitter("diarized")
diarized_breaks = _emitter("breaks")
legacy_breaks = _emitter("legacy")


def text_or_whole(spark, sf_dir):
    """Long conversations have segments, short ones their first turn as a whole."""
    rows = _segments(spark, sf_dir)
    whole = rows.where("seg_no = 0").select("conv_id", F.concat(F.lit("  "), F.upper("speaker")).alias("whole"))
    return transcript.text_of_each(rows.where("conv_id % 3 = 0"), ["conv_id"], whole)


def named_speakers(spark, sf_dir):
    """Speakers by a map of names, and by their place of appearance in a list."""
    rows = with_appearance(_segments(spark, sf_dir), ["conv_id"], "speaker", "seg_no")
    names = F.create_map(F.lit("user"), F.lit(" Ann "), F.lit("assistant"), F.lit(" "))
    return rows.select("conv_id", "seg_no", transcript.display_name(F.col("speaker"), names).alias("mapped"), transcript.display_name(F.col("speaker"), None, F.col("label_no"), ["First"]).alias("listed"))

JSONS = [
    (1, '[{"start": 1.5, "end": 2, "text": " a {w} "}, {"text": "b"}, {"start": 3, "end": 1, "text": "c", "speaker": "S1"}, {"text": " "}]'),
    (2, '{"segments": [{"t0": 150, "t1": 250, "content": "x{n}"}, "plain"]}'),
    (3, '{"transcription": [{"offsets": {"from": 500, "to": 1500}, "text": "y", "label": "Z{n}"}]}'),
    (4, '{"text": "only text {n}"}'),
    (5, "not json"),
    (6, '{"chunks": [{"start": null, "end": 4, "utterance": "n"}]}'),
]


#: The segments of each JSON text: starts, ends, texts and speakers.
SEGMENTS = [
    ("1.5|0|3", "2|0|3", "a {w}|b|c", "||S1"), ("1.5|0", "2.5|0", "x{n}|plain", "|"), ("0.5", "1.5", "y", "Z{n}"), ("0", "0", "only text {n}", ""), ("", "", "", ""), ("0", "4", "n", ""),
]


def segments_from_json(spark, sf_dir):
    return transcript.segments_of_json(forms(spark, sf_dir, "raw string", [(j,) for _, j in JSONS], "doc"), ["doc"], "raw").select("doc", "pos", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text", "speaker")


QUERIES = {
    "currency_rules": currency_rules, "parse_percent": parse_percent, "percent_of_lines": percent_of_lines, "as_of_text": as_of_text,
    "period_start": period_start, "asof_rate": asof_rate, "period_return": period_return, "panel_adjust": panel_adjust,
    "frame_union": frame_union, "positional_concat": positional_concat, "time_formats": time_formats, "speaker_relabel": speaker_relabel,
    "overlap_attribution": overlap_attribution, "emit_txt": emit_txt, "emit_srt": emit_srt, "emit_vtt": emit_vtt, "diarized_txt": diarized_txt,
    "diarized_breaks": diarized_breaks, "legacy_breaks": legacy_breaks, "text_or_whole": text_or_whole, "named_speakers": named_speakers, "segments_from_json": segments_from_json,
}

_TURNS = """g AS (SELECT conv_id, turn AS seg_no, role AS speaker, text AS raw FROM conversations),
    s AS (SELECT *, trim(raw) AS text, sum(length(raw)) OVER (PARTITION BY conv_id ORDER BY seg_no) / 15.0 AS e, sum(length(raw)) OVER (PARTITION BY conv_id ORDER BY seg_no) / 15.0 - length(raw) / 15.0 AS b FROM g)"""
_CLOCK = "printf('%02d:%02d:%02d{m}%03d', CAST(round_even({x} * 1000, 0) AS BIGINT) // 3600000, CAST(round_even({x} * 1000, 0) AS BIGINT) // 60000 % 60, CAST(round_even({x} * 1000, 0) AS BIGINT) // 1000 % 60, CAST(round_even({x} * 1000, 0) AS BIGINT) % 1000)"
_RUNS = """r AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS st FROM {src} WINDOW w AS (PARTITION BY conv_id ORDER BY seg_no)),
    u AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY seg_no) AS run FROM r),
    x AS (SELECT conv_id, run, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY seg_no) AS text FROM u WHERE text <> '' GROUP BY conv_id, run)"""
_MONTHS = r"CAST(nullif(regexp_extract(lower({l}), '(\d+)\s*(month|year)s?', 1), '') AS INT) * CASE WHEN regexp_extract(lower({l}), '(\d+)\s*(month|year)s?', 2) = 'year' THEN 12 ELSE 1 END"
_START = "CASE WHEN lower({l}) = 'ytd' THEN make_date(year({d}), 1, 1) ELSE CAST({d} - to_months(" + _MONTHS + ") AS DATE) END"
_FIX = values_sql("rate_date date, currency string, rate double", RATES)
_FX = f"""((SELECT rate FROM {_FIX} q WHERE currency = target AND rate_date <= {{d}} ORDER BY rate_date DESC LIMIT 1) / (SELECT rate FROM {_FIX} q WHERE currency = base AND rate_date <= {{d}} ORDER BY rate_date DESC LIMIT 1))"""
_CELL = "(TRY_CAST(regexp_replace({c}, '[%,]', '', 'g') AS DOUBLE) / 100)"


def _cell(column: str, label: str) -> str:
    start = _START.format(l=f"'{label}'", d="as_of")
    own = f"CASE WHEN contains({column}, '%') THEN {_CELL.format(c=column)} END"
    fx = f"({_FX.format(d='as_of')} / {_FX.format(d=start)} - 1)"
    return own, fx


def _panel_sql() -> str:
    cells = {c: _cell(f'"{c}"', p) for c, p in (("ytd", "ytd"), ("1_month", "1 month"), ("1_year", "1 year"))}
    differ = "base <> '' AND target <> '' AND base <> target"
    shown = ", ".join(f'round(CASE WHEN {differ} AND {own} IS NOT NULL AND {fx} IS NOT NULL THEN (1 + {own}) * (1 + {fx}) - 1 ELSE {own} END, 9) AS "{c}"' for c, (own, fx) in cells.items())
    applied = " OR ".join(f"({differ} AND {own} IS NOT NULL AND {fx} IS NOT NULL)" for own, fx in cells.values())
    rows = f"(SELECT symbol || '-' || pos AS symbol, * EXCLUDE (pos, symbol) FROM {forms_sql(_PANEL_COLUMNS, PANEL)})"
    return f"SELECT symbol, {shown}, {applied} AS applied FROM {rows}"


ORACLES = {
    "currency_rules": rf"""WITH s AS (SELECT pos, symbol, upper(trim(coalesce(symbol, ''))) AS u, list_filter(list_transform(string_split(upper(coalesce(symbol, '')), ':'), lambda x: trim(x)), lambda x: x <> '') AS p FROM {forms_sql('symbol string', [(x,) for x in SYMBOLS])})
        SELECT pos, CASE WHEN u = 'GBX' THEN 'GBP' ELSE u END AS code, CASE WHEN p[-1] = 'GBX' THEN 'GBP' WHEN regexp_matches(coalesce(p[-1], ''), '^[A-Z]{{3}}$') THEN p[-1] ELSE '' END AS target,
               CASE WHEN trim(coalesce(symbol, '')) = '' OR contains(symbol, ':') THEN trim(coalesce(symbol, '')) ELSE trim(symbol) || ':EUR' END AS "full", u IN ('', 'NAN') AS blank FROM s""",
    "parse_percent": f"SELECT pos, round(CASE WHEN contains(cell, '%') THEN TRY_CAST(trim(regexp_replace(replace(cell, '−', '-'), '[%,]', '', 'g')) AS DOUBLE) / 100 END, 9) AS fraction FROM {forms_sql('cell string', [(x,) for x in PERCENTS])}",
    "percent_of_lines": "SELECT l_discount, count(*) AS n, round(l_discount * 1000, 6) AS fraction FROM lineitem GROUP BY 1",
    "as_of_text": f"SELECT pos, CAST(try_strptime(nullif(regexp_extract(text, '(?i)as of ([A-Z][a-z]{{2}} \\d{{1,2}}),? (\\d{{4}})', 1), '') || ' ' || regexp_extract(text, '(?i)as of ([A-Z][a-z]{{2}} \\d{{1,2}}),? (\\d{{4}})', 2), '%b %d %Y') AS DATE) AS as_of FROM {forms_sql('text string', [(x,) for x in AS_OF_TEXTS])}",
    "period_start": f"SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, label, {_START.format(l='label', d='CAST(o_orderdate AS DATE)')} AS start FROM orders, {values_sql('label string', [(x,) for x in LABELS])}",
    "asof_rate": """WITH v AS (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
        SELECT p.event_id, v.value AS rate FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "period_return": f"""WITH r AS (SELECT CAST(o_orderdate AS DATE) AS rate_date, c_mktsegment AS currency, round(avg(o_totalprice), 6) AS rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
        e AS (SELECT currency, max(rate_date) AS day FROM r GROUP BY currency, date_trunc('quarter', rate_date)),
        p AS (SELECT *, CAST(day - to_months(3) AS DATE) AS start FROM e)
        SELECT p.currency, day, round(a.rate / b.rate - 1, 9) AS period_return FROM p ASOF LEFT JOIN r a ON p.currency = a.currency AND p.day >= a.rate_date ASOF LEFT JOIN r b ON p.currency = b.currency AND p.start >= b.rate_date""",
    "panel_adjust": _panel_sql(),
    "frame_union": "SELECT DISTINCT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, '' AS kind FROM nation UNION SELECT r_name, '', 'x' FROM region",
    "positional_concat": """SELECT row_no, n_name, r_name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS row_no, n_name FROM nation) FULL JOIN (SELECT row_number() OVER (ORDER BY r_regionkey) AS row_no, r_name FROM region) USING (row_no)""",
    "time_formats": f"""WITH t AS (SELECT pos, seconds, greatest(seconds, 0) AS c FROM (SELECT pos, seconds + pos % 1000 * 0.5::DOUBLE AS seconds FROM {forms_sql('seconds double', [(x,) for x in SECONDS])}))
        SELECT pos, {_CLOCK.format(m=',', x='c')} AS srt, {_CLOCK.format(m='.', x='c')} AS vtt,
               CASE WHEN seconds < 0 THEN 'unknown' WHEN seconds >= 3600 THEN printf('%d:%02d:%02d', CAST(floor(seconds) AS BIGINT) // 3600, CAST(floor(seconds) AS BIGINT) // 60 % 60, CAST(floor(seconds) AS BIGINT) % 60)
                    ELSE printf('%02d:%02d', CAST(floor(seconds) AS BIGINT) // 60, CAST(floor(seconds) AS BIGINT) % 60) END AS shown, round_even(c * 1000, 0) / 1000 AS back FROM t""",
    "speaker_relabel": """WITH f AS (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY f) - 1 AS label_no FROM f)
        SELECT conv_id, turn AS seg_no, label_no FROM conversations JOIN k USING (conv_id, role)""",
    "overlap_attribution": """WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events),
        s AS (SELECT user_id, event_id AS seg_no, t AS b, t + 60 + event_id % 30000 AS f FROM e),
        u AS (SELECT user_id, event_id AS turn_no, t - 7200 AS tb, t + 7200 AS tf, event_type || '-' || (event_id % 3) AS speaker FROM e WHERE event_type IN ('view', 'click')),
        j AS (SELECT s.user_id, seg_no, speaker FROM s LEFT JOIN u ON s.user_id = u.user_id AND tb < f AND tf > b
              QUALIFY row_number() OVER (PARTITION BY s.user_id, seg_no ORDER BY least(f, tf) - greatest(b, tb) DESC NULLS LAST, turn_no) = 1),
        k AS (SELECT user_id, speaker, row_number() OVER (PARTITION BY user_id ORDER BY min(seg_no)) - 1 AS n FROM j WHERE speaker IS NOT NULL GROUP BY 1, 2)
        SELECT j.user_id, seg_no, j.speaker, CASE WHEN n IS NOT NULL THEN printf('SPEAKER_%02d', n) END AS label FROM j LEFT JOIN k ON j.user_id = k.user_id AND j.speaker = k.speaker""",
    "emit_txt": f"WITH {_TURNS} SELECT conv_id, string_agg(text, chr(10) ORDER BY seg_no) AS out FROM s WHERE text <> '' GROUP BY 1",
    "emit_srt": f"WITH {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seg_no) AS i FROM s WHERE text <> '') SELECT conv_id, string_agg(i || chr(10) || {_CLOCK.format(m=',', x='b')} || ' --> ' || {_CLOCK.format(m=',', x='e')} || chr(10) || text, chr(10) || chr(10) ORDER BY seg_no) AS out FROM n GROUP BY 1",
    "emit_vtt": f"WITH {_TURNS} SELECT conv_id, 'WEBVTT' || coalesce(chr(10) || chr(10) || string_agg({_CLOCK.format(m='.', x='b')} || ' --> ' || {_CLOCK.format(m='.', x='e')} || chr(10) || text, chr(10) || chr(10) ORDER BY seg_no) FILTER (text <> ''), '') AS out FROM s GROUP BY 1",
    "diarized_txt": f"WITH {_TURNS}, t AS (SELECT * FROM s WHERE text <> ''), {_RUNS.format(src='t')} SELECT conv_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY run) AS out FROM x GROUP BY 1",
    "diarized_breaks": f"WITH {_TURNS}, t AS (SELECT * FROM s WHERE text <> ''), {_RUNS.format(src='t')} SELECT conv_id, string_agg(text, chr(10) || '{transcript.BREAK}' || chr(10) ORDER BY run) AS out FROM x GROUP BY 1",
    "legacy_breaks": f"WITH {_TURNS}, {_RUNS.format(src='s')} SELECT conv_id, string_agg('{transcript.BREAK}' || chr(10) || text, chr(10) ORDER BY run) AS out FROM x GROUP BY 1",
    "text_or_whole": f"WITH {_TURNS}, t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY seg_no) AS out FROM s WHERE text <> '' AND conv_id % 3 = 0 GROUP BY 1) SELECT s.conv_id, coalesce(t.out, upper(speaker)) AS out FROM s LEFT JOIN t ON t.conv_id = s.conv_id WHERE seg_no = 0",
    "named_speakers": """WITH f AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS n FROM conversations GROUP BY 1, 2)
        SELECT conv_id, turn AS seg_no, CASE WHEN role = 'user' THEN 'Ann' ELSE role END AS mapped, CASE WHEN n = 1 THEN 'First' ELSE role END AS listed FROM conversations JOIN f USING (conv_id, role)""",
    "segments_from_json": f"""SELECT doc, unnest(pos) AS pos, CAST(unnest(string_split(starts, '|')) AS DOUBLE) AS start, CAST(unnest(string_split(ends, '|')) AS DOUBLE) AS "end",
        unnest(string_split(texts, '|')) AS text, nullif(unnest(string_split(speakers, '|')), '') AS speaker FROM (SELECT *, range(0, len(string_split(texts, '|'))) AS pos FROM {forms_sql('starts string, ends string, texts string, speakers string', SEGMENTS, 'doc')} WHERE texts <> '')""",
}
