"""Stateful operators: a run that stops and goes on gives what one pass over all rows gives."""

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lintel.plans import registry
from lintel.streaming import progress, stateful

CHUNKS = "run long, seq long, at timestamp, chunk binary, ended boolean"
BASE = 1_700_000_000


def _time(second):
    return pd.Timestamp(BASE + second, unit="s").to_pydatetime()


def _said(rng, runs):
    """Lines of two sources for each run, cut into chunks anywhere; some sources never end, some say nothing."""
    rows = []
    for run in range(runs):
        for source in ("out", "err"):
            if run % 7 == 3 and source == "err":
                continue
            text = "".join(rng.choice(["é", "x", "\n", "\r\n", "ab", "日本"]) for _ in range(rng.randint(0, 60))).encode()
            cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randint(0, 6))))
            chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            for seq, chunk in enumerate(chunks):
                last = seq == len(chunks) - 1
                rows.append((source, run, seq, run * 40 + seq * 4 + (source == "err"), chunk, last and not (run % 5 == 2 and source == "out")))
    return rows


def _merged(rows, drain, until):
    """Run by run, second by second."""
    out = []
    for run in sorted({r[1] for r in rows}):
        own = sorted((r for r in rows if r[1] == run), key=lambda r: (r[3], r[0], r[2]))
        pending, counts, ends, closed = {"out": b"", "err": b""}, {"out": 0, "err": 0}, {}, False
        for source, _, _, at, chunk, ended in own:
            if ends and at > min(ends.values()) + drain:
                break
            *lines, pending[source] = (pending[source] + chunk).split(b"\n")
            if ended:
                lines += [pending[source]] if pending[source] else []
                pending[source] = b""
                ends[source] = at
            for line in lines:
                out.append((run, "line", source, counts[source], at, line.removesuffix(b"\r").decode("utf-8", "replace")))
                counts[source] += 1
        if len(ends) == 2:
            out.append((run, "end", None, None, max(ends.values()), None))
            closed = True
        if not closed and ends and min(ends.values()) + drain < until:
            at = min(ends.values()) + drain
            out += [(run, "line", s, counts[s], at, p.removesuffix(b"\r").decode("utf-8", "replace")) for s, p in pending.items() if p and s not in ends]
            out.append((run, "cut", None, None, at, None))
    return sorted(out, key=str)


def _found(df):
    return sorted(((r["run"], r["kind"], r["source"], r["line_no"], int(r["at"].timestamp()) - BASE, r["line"]) for r in df.collect()), key=str)


def _stream(spark, folder, files=None):
    reader = spark.readStream.schema(CHUNKS)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def _write(spark, rows, folder, source):
    mine = [(run, seq, _time(at), bytearray(chunk), ended) for s, run, seq, at, chunk, ended in rows if s == source]
    spark.createDataFrame(mine, CHUNKS).coalesce(1).write.mode("append").parquet(f"{folder}/{source}")


@pytest.mark.parametrize("steps", [1, 4])
def test_merged_lines_go_on_from_their_checkpoint(spark, tmp_path, steps):
    """Rows come in several pieces; the query stops after each and goes on with its state."""
    rows = sorted(_said(random.Random(5), 24), key=lambda r: r[3])
    last = rows[-1][3]
    folder = str(tmp_path)
    for step in range(steps):
        low, high = last * step / steps, last * (step + 1) / steps
        piece = [r for r in rows if (low < r[3] or step == 0) and r[3] <= high]
        for source in ("out", "err"):
            _write(spark, piece, folder, source)
        lines = stateful.merged_lines(_stream(spark, f"{folder}/out"), _stream(spark, f"{folder}/err"), 10)
        found = stateful.drained(lines, f"{folder}/query")
    until = min(max(r[3] for r in rows if r[0] == s) for s in ("out", "err"))
    expected = _merged(rows, 10, until)
    assert {r[1] for r in expected} == {"line", "end", "cut"}
    assert _found(found) == expected


def test_chunks_that_come_ahead_of_their_turn_wait(spark, tmp_path):
    rows = [("out", 1, 0, 0, b"a", False), ("out", 1, 1, 1, b"b\nc", False), ("out", 1, 2, 2, b"d\n", False), ("out", 1, 3, 3, b"e", True), ("err", 1, 0, 4, b"", True)]
    folder, found = str(tmp_path), None
    for piece in ([rows[2], rows[4]], [rows[3], rows[1]], [rows[0], rows[1], rows[0]]):  # repeats count once
        for source in ("out", "err"):
            _write(spark, piece, folder, source)
        lines = stateful.merged_lines(_stream(spark, f"{folder}/out"), _stream(spark, f"{folder}/err"), 10, "1 hour")
        found = stateful.drained(lines, f"{folder}/query")
    told = [(r["kind"], r["line_no"], r["line"]) for r in found.orderBy("at", "kind", "line_no").collect()]
    assert sorted(told, key=str) == sorted([("line", 0, "ab"), ("line", 1, "cd"), ("line", 2, "e"), ("end", None, None)], key=str)


class _Counted:
    """States of one key that count what they are asked and told."""

    def __init__(self):
        self.calls, self.values = [], {}

    def getValueState(self, name, schema):
        known = self

        class Value:
            def exists(self):
                known.calls.append("exists")
                return name in known.values

            def get(self):
                known.calls.append("get")
                return known.values.get(name)

            def update(self, value):
                known.calls.append("update")
                known.values[name] = value

        return Value()

    def getMapState(self, name, *schemas):
        known = self

        class Map:
            def __getattr__(self, called):
                return lambda *_: known.calls.append(called)

        return Map()

    def registerTimer(self, at):
        self.calls.append("timer")


def test_a_key_asks_for_its_state_once(spark):
    """A key's state is read once and written once, however many chunks come; keys take rows and make no frame each."""
    chunk = Row("run", "source", "seq", "at", "us", "chunk", "ended")
    rows = [chunk(7, source, k, None, (10 + k) * 1_000_000, b"a\n", k == 3) for k in range(4) for source in ("out", "err")]
    merger, states = stateful.LineMerger(("err", "out"), 10), _Counted()
    merger.init(states)
    first = list(merger.handleInputRows((7,), iter(rows[:4]), None))
    assert states.calls == ["get", "update"] and len(first) == 4
    rest = list(merger.handleInputRows((7,), iter(rows[4:]), None))
    assert states.calls == ["get", "update"] * 2
    assert [r["kind"] for r in rest] == ["line"] * 4 + ["end"] and [r["line_no"] for r in rest if r["source"] == "out"] == [2, 3]
    assert list(merger.handleInputRows((7,), iter(rows), None)) == [] and states.calls == ["get", "update"] * 2 + ["get"]

    update = Row("stage", "seq", "at", "us", "kind", "completed", "total", "force")
    life, states = stateful.ReportLife(15, False), _Counted()
    life.init(states)
    shown = list(life.handleInputRows((1,), iter([update(1, k, None, k * 20_000_000, "update", float(k), 4.0, False) for k in (1, 2)]), None))
    assert [r["percent"] for r in shown] == [25.0, 50.0] and states.calls == ["get", "update"]


def test_rows_without_a_time_or_a_number_are_taken_last(spark):
    chunk = Row("run", "source", "seq", "at", "us", "chunk", "ended")
    merger = stateful.LineMerger(("err", "out"), 10)
    merger.init(_Counted())
    rows = [chunk(1, "out", None, None, None, b"c\n", None), chunk(1, None, 0, None, 5, b"x\n", True), chunk(1, "out", 0, None, 5, None, False)]
    assert [r["line"] for r in merger.handleInputRows((1,), iter(rows), None)] == ["c"]


UPDATES = "stage long, seq long, at timestamp, kind string, completed double, total double, force boolean"


def _life(rows, begun, interval, until, ticking=True):
    out = []
    for stage in sorted({r[0] for r in rows} | set(begun)):
        start, shown, ticks, is_open = (begun[stage], None, 0, True) if stage in begun else (None, None, 0, False)

        def tick(before):
            nonlocal ticks, shown
            while ticking and is_open and start + (ticks + 1) * interval < before:
                ticks += 1
                shown = start + ticks * interval
                percent = min(95.0, 5 + 2.5 * ticks)
                out.append((stage, "tick", shown, percent, float(shown - start)))

        for _, _, at, kind, completed, total, force in sorted((r for r in rows if r[0] == stage), key=lambda r: (r[2], r[1])):
            tick(at)
            if kind == "start":
                start, shown, ticks, is_open = at, None, 0, True
                out.append((stage, "start", at, None, 0.0))
                continue
            start = at if start is None else start
            if kind == "finish":
                if ticking and is_open:
                    out.append((stage, "update", at, 100.0, float(at - start)))
                out.append((stage, "finish", at, None, float(at - start)))
                is_open = False
            elif force or shown is None or at - shown >= interval:
                shown = at
                out.append((stage, "update", at, 100.0 * min(max(completed, 0.0), total) / total if completed is not None and total else None, float(at - start)))
        tick(until)
    return sorted(out, key=str)


@pytest.mark.parametrize(("steps", "ticking"), [(1, True), (5, True), (3, False)])
def test_reports_go_on_from_their_checkpoint(spark, tmp_path, steps, ticking):
    rng, rows = random.Random(8), []
    for stage in range(30):
        at = stage * 11
        if stage % 6:
            rows.append((stage, 0, at, "start", None, None, False))
        for k in range(rng.randint(0, 8)):
            at += rng.randint(1, 25)
            rows.append((stage, k + 1, at, "update", None if k % 4 == 3 else float(k), 8.0 if k % 5 else None, k % 6 == 5))
        if stage % 4 != 1:
            rows.append((stage, 20, at + 17, "finish", None, None, False))
            if stage % 9 == 0:
                rows.append((stage, 21, at + 40, "start", None, None, False))
    begun = {s: s * 11 - 33 for s in range(0, 30, 6)}
    last = max(r[2] for r in rows)
    known = spark.createDataFrame([(s, _time(t)) for s, t in begun.items()], "stage long, start timestamp")
    for step in range(steps):
        low, high = last * step / steps, last * (step + 1) / steps
        piece = [(s, q, _time(at), *rest) for s, q, at, *rest in rows if (low < at or step == 0) and at <= high]
        spark.createDataFrame(piece, UPDATES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(UPDATES).parquet(f"{tmp_path}/in")
        found = stateful.drained(stateful.reports(stream, 10, known, ticking), f"{tmp_path}/query")
    got = sorted(((r["stage"], r["kind"], int(r["at"].timestamp()) - BASE, r["percent"], r["elapsed"]) for r in found.collect()), key=str)
    expected = _life(rows, begun, 10, last, ticking)
    assert got == expected
    assert ("tick" in {r[1] for r in got}) == ticking


def test_report_lifecycle_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    last = {}
    for r in turns:
        last[r["conv_id"]] = max(last.get(r["conv_id"], 0), r["turn"])
    rows = []
    for r in turns:
        at = r["conv_id"] * 3600 + r["turn"] * 10 + len(r["text"]) % 7
        kind = "start" if r["turn"] == 0 and r["conv_id"] % 5 else "finish" if r["turn"] == last[r["conv_id"]] else "update"
        rows.append((r["conv_id"], r["turn"], at, kind, r["turn"] + 1.0, last[r["conv_id"]] + 1.0, r["turn"] % 4 == 3))
    begun = {c: c * 3600 - 60 for c in last if c % 5 == 0}
    found = registry.queries()["report_lifecycle"](spark, sf).collect()
    got = sorted(((r["stage"], r["kind"], r["at"] - 1_600_000_000, None if r["percent"] is None else round(r["percent"], 6), r["elapsed"]) for r in found), key=str)
    expected = [(*x[:3], None if x[3] is None else round(x[3], 6), x[4]) for x in _life(rows, begun, 15, max(r[2] for r in rows))]
    assert got == sorted(expected, key=str)


def test_reassembly_of_a_key_across_partitions(spark):
    """One key holds most chunks; sums are handed on from partition to partition, and no window spans a key."""
    rng = random.Random(2)
    texts = {"hot": "".join(rng.choice(["é\n", "x", "日", "\r\n", "\n\n"]) for _ in range(3000)), "a": "", "b": "\n", "c": "no feed", "d": "x\r", None: "of no key\nlast\n"}
    rows = []
    for run, text in texts.items():
        raw, at, seq = text.encode(), 0, 0
        while at < len(raw) or seq == 0:
            size = rng.randint(1, 5)
            rows.append((run, seq, bytearray(raw[at : at + size])))
            at, seq = at + size, seq + 1
    rows.append(("c", 99, None))
    found = progress.reassembled_lines(spark.createDataFrame(rows, "run string, seq long, chunk binary"), ["run"]).collect()
    expected = []
    for run, text in texts.items():
        lines = text.removesuffix("\n").split("\n") if text else []
        expected += [(run, k, line.removesuffix("\r")) for k, line in enumerate(lines)]
    assert sorted(((r["run"], r["line_no"], r["line"]) for r in found), key=str) == sorted(expected, key=str)
    assert progress.reassembled_lines(spark.createDataFrame([], "run string, seq long, chunk binary"), ["run"]).count() == 0


def test_a_stream_that_has_no_rows(spark, tmp_path):
    for source in ("out", "err"):
        spark.createDataFrame([], CHUNKS).write.parquet(f"{tmp_path}/{source}")
    lines = stateful.merged_lines(_stream(spark, f"{tmp_path}/out"), _stream(spark, f"{tmp_path}/err"))
    assert stateful.drained(lines, f"{tmp_path}/{uuid.uuid4().hex}").count() == 0
    assert spark.conf.get(stateful.STATE_STORE, None) in (None, spark.sparkContext.getConf().get(stateful.STATE_STORE))


def test_running_sums_hand_on_over_partitions(spark):
    from lintel.operators.runs import running_before

    rows = [(k % 3 if k % 50 else None, "x" if k < 1500 else "y", k, k % 7) for k in range(2000)]
    found = running_before(spark.createDataFrame(rows, "a int, b string, o int, v long"), ["a", "b"], "o", "v", "before")
    sums, expected = {}, {}
    for a, b, o, v in rows:
        expected[o] = sums.get((a, b), 0)
        sums[a, b] = expected[o] + v
    assert {r["o"]: r["before"] for r in found.collect()} == expected
    assert found.columns == ["a", "b", "o", "v", "before"]
    assert running_before(spark.createDataFrame(rows, "a int, b string, o int, v long").where(F.lit(False)), ["a"], "o", "v", "s").count() == 0


def test_a_micro_batch_shuffles_by_its_key_alone(spark, monkeypatch):
    """What chunks and updates need of other rows is joined before the stream: every micro-batch would join it again."""
    plans = []

    def kept(stream, folder=None):
        plans.append(stream._jdf.queryExecution().analyzed().toString())
        return spark.createDataFrame([], stream.schema)

    monkeypatch.setattr(stateful, "drained", kept)
    for name in ("merged_line_streams", "report_lifecycle"):
        registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("Join" in plan or "Window" in plan for plan in plans)
    assert "Union" in plans[0]
