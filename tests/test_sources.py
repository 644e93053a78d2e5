"""Files in and out."""

import datetime as dt
import json

import make
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ocheline import schemas
from ocheline.operators import events
from ocheline.sources import frames, outbox, tables


def event(id, **change):
    return {
        "id": str(id),
        "sessionId": "s",
        "playerId": "a",
        "capturedAt": "2024-01-01T12:00:00.250Z",
        "impact": {"xNormalized": 0.1, "yNormalized": -0.2},
        "detected": {"segment": 20, "multiplier": 3, "score": 60, "notation": "T20", "confidence": 0.9},
        "calibrationId": "c",
        "source": "camera",
        **change,
    }


def write_lines(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))
    return str(folder)


def test_read_throws(spark, tmp_path):
    lines = [json.dumps(event(i)) for i in range(3)]
    lines += [
        json.dumps(event(3, capturedAt="2024-01-01T14:00:00+02:00")),
        json.dumps(event(4, capturedAt="2024-01-01T12:00:00")),
        json.dumps(event(8, capturedAt="2024-01-01T14:00:00+02")),
        json.dumps(event(5, capturedAt="noon")),
        json.dumps(event(6, detected="T20")),
        '{"id": "7", "sess',
    ]
    good, bad = tables.read_throws(spark, write_lines(tmp_path / "in", "a.json", lines))
    rows = {r.id: r for r in good.collect()}
    assert sorted(rows) == ["0", "1", "2", "3", "4", "8"]
    assert rows["0"].captured_at == dt.datetime(2024, 1, 1, 12, 0, 0, 250000)
    assert {rows[k].captured_at for k in "348"} == {dt.datetime(2024, 1, 1, 12)}
    assert (rows["0"].score, rows["0"].x, rows["0"].turn_id, rows["0"].correction_of) == (60, 0.1, None, None)
    assert sorted((r.reason, r.id) for r in bad.collect() if r.reason == "captured_at") == [("captured_at", "5")]
    assert bad.filter("reason = 'malformed'").count() == 2
    assert bad.count() == 3
    assert good.schema.fieldNames() == schemas.THROWS.fieldNames()


def test_nested_there_and_back(spark, tmp_path):
    t = make.table(spark, [make.throw(1, "T20"), make.throw(2, "D5", of=1, second=1.5)])
    path = str(tmp_path / "nested")
    events.nest_throws(t).write.json(path)
    good, bad = tables.read_throws(spark, path)
    assert bad.count() == 0 and good.exceptAll(t).count() == 0 and t.exceptAll(good).count() == 0
    events.nest_throws(t).write.parquet(path + "-parquet")
    again, _ = tables.read_throws(spark, path + "-parquet", "parquet")
    assert again.exceptAll(t).count() == 0 and again.count() == 2


def test_store_by_day(spark, tmp_path):
    day = 86400
    rows = [make.throw(i, second=day * (i % 3)) for i in range(30)]
    path = str(tmp_path / "stored")
    tables.write_throws(make.table(spark, rows), path)
    tables.write_throws(make.table(spark, [make.throw(99, second=0)]), path)
    stored = tables.stored_throws(spark, path)
    assert stored.count() == 31
    one = stored.filter(F.col("capture_date") == dt.date(2024, 1, 2))
    assert one.count() == 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(capture_date" in plan


def test_outbox_takes_each_event_once(spark, tmp_path):
    path = str(tmp_path / "outbox")
    t = make.table(spark, [make.throw(i, "S5") for i in range(5)])
    pairs = [("notation", "field"), ("score", "points")]

    def send(df, adapter):
        outbox.publish(events.to_adapter(df, pairs, adapter, keep=["captured_at"]), path)

    send(t.filter("id < 3"), "one")
    send(t.unionByName(t), "one")
    send(t, "two")
    send(t, "two")
    send(t.withColumn("captured_at", F.col("captured_at") + F.expr("INTERVAL 1 DAY")), "two")
    found = outbox.delivered(spark, path)
    assert {(r.adapter, r["count"]) for r in found.groupBy("adapter").count().collect()} == {("one", 5), ("two", 5)}
    assert found.select("adapter", "id").distinct().count() == 10
    assert json.loads(found.first().payload) == {"field": "S5", "points": 5}


def test_frames_from_files(spark, tmp_path):
    for session in ("s1", "s2"):
        (tmp_path / "frames" / session).mkdir(parents=True)
        for n in range(3):
            (tmp_path / "frames" / session / f"{n}.jpg").write_bytes(b"x" * (n + 1))
    path = str(tmp_path / "frames")
    rows = tables.read_frames(spark, path).collect()
    assert sorted((r.session_id, r.frame_no, r.n_bytes) for r in rows) == [(s, n, n + 1) for s in ("s1", "s2") for n in range(3)]
    assert "content" not in rows[0].asDict()
    assert tables.read_frames(spark, path, with_bytes=True).filter("frame_no = 1").first().content == b"xx"


def test_overlapping_deliveries_at_once(spark, tmp_path, monkeypatch):
    """Both look before either has written; each event is delivered once all the same."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    path, met, real = str(tmp_path / "outbox"), Barrier(2), outbox.written

    def look(*args):
        found = real(*args)
        met.wait(60)
        return found

    def shaped(ids):
        return events.to_adapter(make.table(spark, [make.throw(i, "S1") for i in ids]), [("score", "points")], "one", keep=["captured_at"])

    outbox.publish(shaped(range(3)), path)
    monkeypatch.setattr(outbox, "written", look)
    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(outbox.publish, shaped(ids), path) for ids in (range(30), range(10, 40))]:
            done.result()
    monkeypatch.undo()
    found = outbox.delivered(spark, path).collect()
    assert sorted(int(r.id) for r in found) == list(range(40))
    assert outbox.written(spark, path).count() == 60 - 2 * 3 + 3 + 3  # 10 to 29 twice, 0 to 2 once
    outbox.publish(shaped(range(40)), path)
    assert outbox.delivered(spark, path).count() == 40


def test_frames_written_by_tasks(spark, tmp_path):
    rows = [("s1", 1, b"abc"), ("s1", 2, b""), ("s2", 1, b"x" * 70_000), ("s2", 1, b"x" * 70_000), (None, 1, b"a"), ("s", None, b"a"), ("a/b", 1, b"a"), ("s", 3, None)]
    df = spark.createDataFrame(rows, "session_id string, frame_no int, content binary").repartition(3)
    path = f"file://{tmp_path}/frames"
    for _ in range(2):  # a repeated write changes nothing
        frames.write_frames(df, path, "png")
        found = tables.read_frames(spark, path, with_bytes=True).collect()
        assert sorted((r.session_id, r.frame_no, bytes(r.content)) for r in found) == [("s1", 1, b"abc"), ("s2", 1, b"x" * 70_000)]
        assert all(r.path.endswith(".png") for r in found)


def test_frames_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """No list of the files on the driver, and no task for every few small ones."""
    folder = tmp_path / "frames"
    for n in range(400):
        (folder / f"s{n % 3}").mkdir(parents=True, exist_ok=True)
        (folder / f"s{n % 3}" / f"{n}.png").write_bytes(b"x" * (n % 5 + 1))
    monkeypatch.setattr(frames, "ROWS", 7, raising=False)
    monkeypatch.setattr(frames, "BYTES", 3, raising=False)
    found = tables.read_frames(spark, str(folder), with_bytes=True)
    assert not any(name.endswith(".png") for name in found.inputFiles())
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sorted((r.frame_no, r.session_id, r.n_bytes, bytes(r.content)) for r in found.collect())
    assert rows == [(n, f"s{n % 3}", n % 5 + 1, b"x" * (n % 5 + 1)) for n in range(400)]


def test_frames_as_sparks_reader_has_them(spark, tmp_path):
    """Folders in folders, names that are hidden, links, patterns, single files."""
    names = ["7.jpg", "s1/1.jpg", "s1/deep er/é/2.jpg", "s1/none.jpg", "s1/_3.jpg", "_s/1.jpg", "_s=1/1.jpg", ".s/1.jpg"]
    names += ["s2/4.jpg._COPYING_", "s2/.5.jpg", "s2/6.tar.gz", "s2/%20 /8.gz", "_metadata/9.jpg", "s2/99999999999999999999.jpg"]
    folder = tmp_path / "frames"
    for n, name in enumerate(names):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"x" * n)
    (folder / "empty").mkdir()
    (folder / "linked").symlink_to(folder / "s1")
    (folder / "s2" / "10.jpg").symlink_to(tmp_path / "nothing")
    for path in (str(folder), f"file://{folder}/", f"{folder}/s*", f"{folder}/7.jpg", str(folder / "empty")):
        plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        expected = sorted(map(tuple, plain.select("path", "modificationTime", "length", "content").collect()))
        found = tables.read_frames(spark, path, with_bytes=True)
        assert sorted(map(tuple, found.select("path", "captured_at", "n_bytes", "content").collect())) == expected
        assert tables.read_frames(spark, path).schema.names == ["session_id", "frame_no", "captured_at", "n_bytes", "path"]
        assert tables.read_frames(spark, path).count() == len(expected)
        assert found.schema.simpleString() == "struct<session_id:string,frame_no:bigint,captured_at:timestamp,n_bytes:bigint,path:string,content:binary>"
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        tables.read_frames(spark, str(tmp_path / "missing"))


def test_declared_schemas(spark, tmp_path):
    for name, schema, read in [
        ("cal", schemas.CALIBRATIONS, tables.read_calibrations),
        ("marks", schemas.LANDMARKS, tables.read_landmarks),
        ("det", schemas.DETECTIONS, tables.read_detections),
    ]:
        path = str(tmp_path / name)
        spark.createDataFrame([], schema).write.parquet(path)
        assert read(spark, path).schema == schema
    path = write_lines(tmp_path / "issues", "i.json", ['{"repo":"r","number":3,"title":"t","state":"open","native_blockers":[1]}'])
    (row,) = tables.read_issues(spark, path).collect()
    assert (row.number, row.native_blockers, row.assignee) == (3, [1], None)
