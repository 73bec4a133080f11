"""Imports that go on where the last one ended, and tables that change together."""

import json

import pytest
from pyspark.sql import functions as F
from tidemark.operators import commits, store
from tidemark.sources import intake, jsonl, lines, transcripts
from tidemark.streaming import watch

STAMP = {"timestamp": "2024-01-01T00:00:00Z", "cwd": "/p"}


def say(k):
    return {"type": "user", "uuid": f"u{k}", "message": {"content": f"say {k}"}, **STAMP}


def call(k):
    return {"type": "assistant", "uuid": f"a{k}", "message": {"content": [{"type": "tool_use", "id": f"t{k}", "name": "Bash", "input": {"command": f"ls {k}"}}]}, **STAMP}


def result(k):
    return {"type": "user", "uuid": f"r{k}", "message": {"content": [{"type": "tool_result", "tool_use_id": f"t{k}", "is_error": True, "content": "Exit code 3"}]}, **STAMP}


def written(folder, records, name="a.jsonl"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))
    return str(folder)


def shape(events):
    return sorted((r.sequence, r.type, r.event_id, r.parent_event_id) for r in events.collect())


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    texts = [f'{{"n": {k}, "fill": "{"é" * (k % 50)}"}}' if k % 7 else "" for k in range(400)]
    body = "\n".join(texts).encode() + b"\r\n" + "the ünfinished".encode()
    (tmp_path / "long.jsonl").write_bytes(body)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "short.jsonl").write_text("one\n\ntwo\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for parts in (7, 1):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(body) // parts + 1))
            got = [(r.file, r.line, r.text, r.end, r.partial) for r in lines.read(spark, str(tmp_path)).orderBy("file", "line").collect()]
            plain = body.decode().split("\n")
            long = [("long.jsonl", k + 1, x.removesuffix("\r"), body.rindex(b"\n") + 1, k == len(plain) - 1) for k, x in enumerate(plain)]
            assert got == [("b/short.jsonl", k + 1, x, 9, False) for k, x in enumerate(["one", "", "two"])] + long
            assert [r.line for r in lines.scan(spark, str(tmp_path)).where("file = 'long.jsonl'").orderBy("line").collect()] == [k + 1 for k, x in enumerate(plain) if x.strip()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_replaced_file_is_read_anew(spark, tmp_path):
    """By batch, with the stored events alone and with the kept states; what the file held before stays."""
    scan = lambda records: lines.scan(spark, written(tmp_path / "logs", records))
    first = jsonl.import_transcripts(scan([say(k) for k in range(10)]), transcripts.claude)
    assert first.events.count() == 11
    fresh = [say(100), call(1), call(2), result(2), result(1), say(101), call(3), result(3)]
    resume = transcripts.Resume(first.frames["states"], first.frames["open_calls"], first.events.select("event_id", "sequence"))
    for kept in ({}, {"resume": resume}):
        done = jsonl.import_transcripts(scan(fresh), transcripts.claude, stored=first.events, **kept)
        assert tuple(done.summary.select("inserted", "duplicates", "conflicts", "rejected").first()) == (8, 0, 0, 0)
        assert sorted(r.sequence for r in done.events.collect()) == list(range(11, 19)) and done.frames["states"].first().generation == 1
        both = first.events.unionByName(done.events)
        again = jsonl.import_transcripts(scan(fresh), transcripts.claude, stored=both).summary.first()
        assert (again.events_read, again.inserted, again.duplicates) == (0, 0, 0)
    # a file that lost its end is read again; what is known is found equal
    shorter = jsonl.import_transcripts(scan(fresh[:3]), transcripts.claude, stored=both)
    assert tuple(shorter.summary.select("events_read", "inserted", "duplicates", "conflicts").first()) == (3, 0, 3, 0) and shorter.frames["states"].first().generation == 2


def test_batch_and_stream_share_a_store(spark, tmp_path):
    """Stream, then batch with more lines, then stream again; a replaced file; calls open over three imports; a restart from the tables alone."""
    target, tables = str(tmp_path / "out"), commits.Tables(spark, str(tmp_path / "out"))
    records = [say(1), call(1), call(2), result(2), say(2), call(3), result(1), result(3), say(3), call(4), call(5)]
    logs = written(tmp_path / "logs", records[:6])
    stream = lambda: watch.watch(spark, logs, target, interval=None, adapter="claude").awaitTermination(180)
    batch = lambda: intake.take(tables, lines.scan(spark, logs), transcripts.claude)
    count = lambda: watch.stored_events(spark, target).count()
    stream()
    assert count() == 7
    by_events = jsonl.import_transcripts(lines.scan(spark, written(tmp_path / "logs", records)), transcripts.claude, stored=watch.stored_events(spark, target))
    assert by_events.summary.first().inserted == 5
    batch()
    assert count() == 12 and batch().read("events").count() == 12
    written(tmp_path / "logs", records + [result(4), say(4)])
    stream()  # reads again what the batch took, and two lines more
    assert count() == 14
    whole = jsonl.import_transcripts(lines.scan(spark, logs), transcripts.claude)
    assert shape(watch.stored_events(spark, target)) == shape(whole.events)
    assert [(r.call_id, r["__open"].tool_name) for r in intake.resume_of(tables.snapshot(), lines.scan(spark, logs)).open_calls.collect()] == [("t5", "Bash")]
    written(tmp_path / "logs", [say(50 + k) for k in range(8)])
    stream()
    assert count() == 22
    batch()
    assert count() == 22 and [r.sequence for r in watch.stored_events(spark, target).orderBy("sequence").collect()] == list(range(22))
    states = tables.snapshot().read("states")
    assert states.orderBy(F.desc("version")).first().generation == 1


def test_an_import_reads_only_its_buckets(spark, tmp_path):
    tables = commits.Tables(spark, str(tmp_path / "store"))
    rows = spark.range(20_000).select(F.concat(F.lit("evt_"), "id").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    places = spark.range(20_000).select(F.concat(F.lit("ses_"), (F.col("id") % 500)).alias("session_id"), F.col("id").alias("sequence"), F.lit("s").alias("source"), F.current_timestamp().alias("occurred_at"), F.concat(F.lit("evt_"), "id").alias("event_id"))
    base = tables.commit(tables.snapshot(), append={"ids": rows, "places": places}, keys=commits.KEYS)
    batch = spark.createDataFrame([("evt_7", "ses_7"), ("evt_new", "ses_new")], "event_id string, session_id string")
    found = base.of_keys("ids", batch, ["event_id"])
    assert found.where("event_id = 'evt_7'").count() == 1 and found.count() < 20_000 * 4 / commits.BUCKETS
    assert found.select(F.input_file_name().alias("f")).distinct().count() <= 2 < len(found.inputFiles())
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().toString()
    events = spark.createDataFrame([("evt_7", "ses_7", "s", 7), ("evt_8", "ses_8", "s", 8), ("evt_new", "ses_7", "s", 7), ("evt_more", "ses_9", "other", 99_999), ("evt_last", "ses_9", "s", 99_998)], "event_id string, session_id string, source string, sequence long")
    events = events.withColumns({"content_hash": F.when(F.col("event_id") == "evt_7", F.sha2(F.lit("7"), 256)).otherwise(F.lit("x")), "ingest_seq": F.col("sequence"), "occurred_at": F.current_timestamp()})
    ids = lambda df: sorted(r.event_id for r in df.collect())
    index = intake.index_of(base)
    taken = store.ingest(events, ids=index.ids(events), held_places=index.places(events))
    assert (ids(taken.accepted), ids(taken.duplicates), ids(taken.conflicts)) == (["evt_last"], ["evt_7"], ["evt_8"])
    assert {r.event_id: r.reason for r in taken.rejected.collect()} == {"evt_new": "sequence_conflict", "evt_more": "session_source_conflict"}


def test_tables_change_together(spark, tmp_path):
    tables = commits.Tables(spark, str(tmp_path / "store"))
    one = tables.commit(tables.snapshot(), append={"a": spark.range(3), "b": spark.range(5)}, notes={"by": "test"})
    two = tables.commit(one, append={"a": spark.range(3, 4)}, replace={"b": spark.range(1)})
    told = lambda s: (s.version, s.read("a").count(), s.read("b").count(), s.notes)
    assert told(tables.snapshot()) == told(two) == (2, 4, 1, {"by": "test"}) and told(tables.snapshot(1)) == (1, 3, 5, {"by": "test"})
    with pytest.raises(Exception, match="broken"):
        tables.commit(two, replace={"a": spark.range(0), "b": spark.range(4).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))})
    assert told(tables.snapshot()) == told(two)
    with pytest.raises(commits.VersionConflict):
        tables.commit(one, replace={"a": spark.range(0)})
    assert told(tables.commit(two, replace={"a": spark.range(0)}, dry_run=True)) == told(tables.snapshot()) == told(two)
    three = tables.commit(two, replace={"a": spark.range(0)})
    assert (three.read("a").count(), three.read("b").count(), three.read("none")) == (0, 1, None)
    folders = lambda: len(list((tmp_path / "store").glob("*/part=*")))
    assert folders() == 4 or folders() == 5
    tables.commit(three, append={"b": spark.range(9)})
    tables.compact("b")
    assert tables.vacuum(keep=1) > 0 and folders() <= 2 and tables.snapshot().read("b").count() == 10


def test_deletion_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    from tidemark.operators import retention

    root = str(tmp_path / "store")
    tables = commits.Tables(spark, root)
    logs = written(tmp_path / "logs", [say(1), say(2)])
    written(tmp_path / "logs", [say(3)], "b.jsonl")
    intake.take(tables, lines.scan(spark, logs), transcripts.claude)
    base = tables.snapshot()
    doomed = base.read("events").where("file = 'a.jsonl'").select("session_id").distinct()
    tried = retention.commit_deletion(tables, doomed, dry_run=True)
    assert tuple(tried.first())[0] == 3 and tables.snapshot().version == base.version
    made = commits.Tables._publish
    monkeypatch.setattr(commits.Tables, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        retention.commit_deletion(tables, doomed)
    monkeypatch.setattr(commits.Tables, "_publish", made)
    assert tables.snapshot().read("events").count() == 5 == tables.snapshot().read("ids").count()
    assert retention.commit_deletion(tables, doomed).first().events_deleted == 3
    after = tables.snapshot()
    assert [after.read(t).count() for t in ("events", "ids", "places")] == [2, 2, 2]


def test_a_tree_of_files_is_watched_behind_its_frontier(spark, tmp_path):
    """A message that ends later is taken once, as it ended; later ones wait for it; what is taken is not read again."""
    root, target = tmp_path / "storage", str(tmp_path / "out")

    def put(path, value):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(value if isinstance(value, str) else json.dumps(value))

    def message(k, role, status=None, session="ses_1"):
        put(f"message/{session}/msg_{session}_{k}.json", {"id": f"msg_{session}_{k}", "role": role, "time": {"created": 1_700_000_000_000 + k, "completed": 1}})
        if status:
            put(f"part/msg_{session}_{k}/prt_1.json", {"type": "tool", "tool": "bash", "callID": f"c{k}", "state": {"status": status, "input": {"command": "ls"}}})

    def cycle():
        watch.watch(spark, str(root), target, interval=None, adapter="opencode").awaitTermination(180)
        return [(r.session_id[-3:], r.sequence, r.type) for r in watch.stored_events(spark, target).orderBy("session_id", "sequence").collect()]

    for session in ("ses_1", "ses_2"):
        put(f"session/p/{session}.json", {"id": session, "directory": "/w", "time": {"created": 1_700_000_000_000}})
    message(0, "user")
    message(1, "assistant", "running")
    message(2, "user")
    message(0, "user", session="ses_2")
    first = cycle()
    assert sorted(t for _, _, t in first) == ["prompt.submitted", "prompt.submitted", "session.started", "session.started"]
    version = commits.Tables(spark, target).snapshot().version
    assert cycle() == first and commits.Tables(spark, target).snapshot().version == version
    message(1, "assistant", "error")
    put("message/ses_1/msg_ses_1_3.json", "{no json")
    second = cycle()
    one = [x for x in second if x not in first]
    assert [t for _, _, t in one] == ["tool.called", "tool.failed", "prompt.submitted"] and [k for _, k, _ in one] == [2, 3, 4] and len(second) == len(first) + 3
    message(3, "assistant", "completed")
    assert [t for _, _, t in cycle() if True][-2:] != [] and len(cycle()) == len(second) + 2
    told = commits.Tables(spark, target).snapshot().read("summaries").agg(F.sum("duplicates"), F.sum("conflicts")).first()
    assert tuple(told) == (0, 0)


def test_a_failing_source_is_reported_once_and_started_again(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.jsonl").write_text("".join(json.dumps({"n": k}) + "\n" for k in range(3)))
    said, calls = [], {"bad": 0, "good": 0}

    def batch(name):
        def run(df, number):
            calls[name] += 1
            if name == "bad" and calls[name] <= 3:
                raise ValueError("the disk is gone")
        return run

    def start(name):
        spark.dataSource.register(watch.Cycles)
        return spark.readStream.format("cycles").load().writeStream.foreachBatch(batch(name)).option("checkpointLocation", str(tmp_path / name / "_offsets")).trigger(processingTime="200 milliseconds").start()

    keeper = watch.Supervisor(spark, {"bad": ("x", ""), "good": ("x", "")}, str(tmp_path), report=lambda *x: said.append(x), pause=0.1, longest=0.3, start=start)
    import time

    until = time.monotonic() + 120
    while time.monotonic() < until and not (calls["bad"] >= 5 and calls["good"] >= 5 and "bad" not in keeper.errors):
        assert keeper.step()
        time.sleep(0.1)
    keeper.stop()
    assert [n for n, _ in said] == ["bad"] and "the disk is gone" in said[0][1]
    assert (keeper.failures, keeper.suppressed) == (1, 2) and calls["bad"] >= 5 and calls["good"] >= 5 and keeper.errors == {}


def test_sources_that_fail_to_start_leave_others_running(spark, tmp_path):
    said = []
    logs = written(tmp_path / "logs", [say(1)])
    keeper = watch.Supervisor(spark, {"none": ("claude", str(tmp_path / "missing")), "one": ("claude", logs)}, str(tmp_path / "out"), interval=None, report=lambda *x: said.append(x))
    keeper.run()
    assert watch.stored_events(spark, str(tmp_path / "out" / "one")).count() == 2
