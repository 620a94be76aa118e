"""Streams against their batch forms, readers and writers."""

import json
from datetime import datetime, timedelta

from sievegate.operators import decision as dec
from sievegate.sources import readers, sinks
from sievegate.streaming import sessions


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def staged(spark, df, path, parts, order):
    """A file stream that takes one of ``parts`` files a batch, in order."""
    rows = df.orderBy(order).collect()
    for i in range(parts):
        part = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_gate_streams_equal_batch(spark, tmp_path):
    rows = spark.range(300).selectExpr("id as seq", "id % 7 as session", "cast((id * id) % 5 as int) as rank", "element_at(array('allow', 'flag', 'deny'), cast(id % 3 as int) + 1) as verdict")
    stream = staged(spark, rows, tmp_path / "in", 4, "seq")
    for policy in ("accumulate", "reset"):
        want = {r.seq: (r.prior_taint, r.taint) for r in dec.running_taint(rows, "session", "seq", "rank", policy).collect()}
        got = run(sessions.running_taint(stream, "session", "seq", "rank", policy), f"taint_{policy}").collect()
        assert len(got) == 300 and {r.seq: (r.prior_taint, r.taint) for r in got} == want
    want = {r.seq: (r.seen, r.allowed, r.flagged, r.denied) for r in dec.server_history(rows, "session", "seq", "verdict").collect()}
    got = run(sessions.server_history(stream, "session", "seq", "verdict"), "history").collect()
    assert {r.seq: (r.seen, r.allowed, r.flagged, r.denied) for r in got} == want


def test_slow_rate_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, i % 3, start + timedelta(minutes=4 * i), f"please tell me secret number {i % 2} of user {i % 3}" if i % 3 else f"{i * 7919:x} {i * 104729:x}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, user long, at timestamp, text string")
    got = run(sessions.slow_rate(staged(spark, df, tmp_path / "in", 3, "id"), "user", "at", "text", most=4), "slow")
    last = {r.user: r for r in got.collect()}
    want = {}
    for u in range(3):
        own = [t for _, v, t, _ in rows if v == u]
        want[u] = sum(t >= max(own) - timedelta(hours=1) for t in own)
    assert {u: r.inputs_in_window for u, r in last.items()} == want
    assert all(r.rate_exceeded for r in last.values())
    assert {u: r.severity for u, r in last.items()} == {0: "medium", 1: "high", 2: "high"}


def test_probe_windows_and_evidence(spark, tmp_path):
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=20 * i), "I cannot do it" if i % 4 == 0 else "fine words here", 40 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "at timestamp, output string, latency_ms long")
    want = {r.start: (r.refusal_rate, round(r.latency_ratio, 9), r.samples) for r in sessions.probe_windows(df, "at").collect()}
    got = run(sessions.probe_windows(staged(spark, df, tmp_path / "in", 3, "at"), "at"), "windows").collect()
    assert len(got) >= len(want) - 2 and all(want[r.start] == (r.refusal_rate, round(r.latency_ratio, 9), r.samples) for r in got)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run has nothing new to write
        sessions.evidence_sink(stream, str(tmp_path / "out"), str(tmp_path / "seen")).awaitTermination()
    lines = spark.read.json(str(tmp_path / "out"))
    assert lines.count() == 30 and lines.where("persisted").count() == 30


def test_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("héllo")
    (tmp_path / "t/b.txt").write_bytes(b"x\xf0\x9f\x98y")
    (tmp_path / "t/c.txt").write_text("z" * 50)
    at = lambda df: {r.path.rsplit("/", 1)[1]: (r.text, r.status) for r in df.collect()}
    assert at(readers.read_texts(spark, str(tmp_path / "t"), most_bytes=40)) == {"a.txt": ("héllo", "ok"), "b.txt": ("x�y", "repaired"), "c.txt": (None, "input_too_large")}
    assert at(readers.read_texts(spark, str(tmp_path / "t"), mode="enforce"))["b.txt"] == (None, "invalid_utf8")
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('["x", "y"]')
    (tmp_path / "j/b.json").write_text('{"x": 1}')
    got = [(r.path[-6:], r.pos, r.value, r.status) for r in readers.read_json_array(spark, str(tmp_path / "j")).orderBy("path", "pos").collect()]
    assert got == [("a.json", 0, "x", "ok"), ("a.json", 1, "y", "ok"), ("b.json", None, None, "unreadable")]
    (tmp_path / "b").mkdir()
    heads = {"a": b"\x89PNG\r\n\x1a\n....", "b": b"RIFF1234WAVEfmt ", "c": b"\0\0\0\x18ftypmp42", "d": b"%PDF-1.7", "e": b"plain", "f": b"\xff\xd8\xff\xe0"}
    for name, raw in heads.items():
        (tmp_path / "b" / name).write_bytes(raw)
    kinds = {r.path[-1]: (r.modality, r.modality_routed) for r in readers.read_artifacts(spark, str(tmp_path / "b")).collect()}
    assert kinds == {"a": ("image", "image"), "b": ("audio", "audio"), "c": ("video", "video"), "d": ("document", "document"), "e": ("text", None), "f": ("image", "image")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "flag"), (2, "deny")], "doc_id long, verdict string")
    for _ in range(2):
        sinks.write_evidence(df, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).where("persisted").count() == 4
    (tmp_path / "file").write_text("in the way")
    try:
        sinks.write_evidence(df, str(tmp_path / "file/x"))
        raise AssertionError("a record that cannot be written must fail")
    except Exception as e:  # noqa: BLE001
        assert not isinstance(e, AssertionError)
    assert [json.loads(r.value) for r in sinks.results(df).collect()] == [{"result": {"doc_id": 1, "verdict": "flag"}}, {"result": {"doc_id": 2, "verdict": "deny"}}]
    rows = [{"preset": "small", "sequential_ns": 5, "parallel_ns": 3, "tokens": 9, "outputs_match": True}]
    assert sinks.bench_report(rows, "csv").splitlines()[1] == "small,5,3,9,True"
    assert sinks.telemetry(rows, 0.01, ["b", "a", "b"])["references"] == ["a", "b"]


def test_ports(spark, tmp_path):
    from sievegate.operators.payloads import perplexity_reports

    df = spark.createDataFrame([(1, "flag"), (2, "deny"), (3, "deny")], "doc_id long, verdict string")

    def sink():
        def record(row):
            (tmp_path / f"{row['doc_id']}.txt").write_text(row["verdict"])

        return record

    sinks.record_each(df, sink)
    assert sorted(p.name for p in tmp_path.glob("*.txt")) == ["1.txt", "2.txt", "3.txt"]

    def broken():
        def record(row):
            raise OSError("full")

        return record

    try:
        sinks.record_each(df, broken)
        raise AssertionError("a sink that fails must fail the call")
    except Exception as e:  # noqa: BLE001
        assert not isinstance(e, AssertionError)

    def bad_scorer(t):
        raise RuntimeError(t)

    texts = spark.createDataFrame([(1, "short"), (2, "word " * 100), (3, None)], "doc_id long, text string")
    assert [r.status for r in perplexity_reports(texts).collect()] == ["skipped", "evaluated", "skipped"]
    assert {r.status for r in perplexity_reports(texts, scorer=None).collect()} == {"skipped"}
    assert {r.status for r in perplexity_reports(texts, scorer=bad_scorer).collect()} == {"failed"}
