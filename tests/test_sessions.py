import pandas as pd
import pytest
from pyspark.sql import functions as F

from annolytics.operators import inference, preview, sessions
from annolytics.streaming import sessions as streams
from annolytics.taxonomy import Taxonomy

NAMES = Taxonomy.of(["person", "helmet", "no_helmet", "no_vest"])
FRAME = "session_id long, frame long, ts timestamp, detections array<struct<class_id:long,class_name:string,confidence:double>>"


def frame(session, number, *names):
    ts = pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=number)
    return (session, number, ts.to_pydatetime(), [(NAMES.id_of(n), n, 0.5) for n in names])


ROWS = [
    frame(1, 0, "person", "no_helmet", "no_vest"),
    frame(1, 1, "helmet"),
    frame(1, 2),
    frame(2, 0),
    frame(2, 3, "no_vest"),
    frame(2, 2, "no_vest", "no_vest"),
]


def test_summary(spark):
    found = {r["session_id"]: r.asDict() for r in sessions.session_summary(spark.createDataFrame(ROWS, FRAME), NAMES).collect()}
    assert found[1] == {
        "session_id": 1,
        "status": "violation_detected",
        "frames_processed": 3,
        "frames_with_violations": 1,
        "total_detection_events": 4,
        "violation_detection_events": 2,
        "max_detections_in_frame": 3,
        "max_violations_in_frame": 2,
        "class_counts": {"helmet": 1, "no_helmet": 1, "no_vest": 1, "person": 1},
        "violation_counts": {"no_helmet": 1, "no_vest": 1},
    }
    assert found[2]["class_counts"] == {"no_vest": 3} and found[2]["violation_counts"]["no_helmet"] == 0


def test_first_violation_frames_and_limits(spark):
    frames = spark.createDataFrame(ROWS, FRAME)
    meta = spark.createDataFrame([(1, 0.0, 10), (2, 2.0, 1000), (3, 10.0, 0), (4, None, 0)], "session_id long, fps double, frame_total long")
    found = sessions.violation_frames(frames, meta, k=1).orderBy("session_id").collect()
    assert [(r["session_id"], r["frame"], r["time_seconds"], len(r["violations"])) for r in found] == [
        (1, 0, 0.0, 2), (2, 2, 1.0, 2)
    ]
    limits = {r["session_id"]: (r["verdict"], r["fps"]) for r in sessions.session_limits(frames, meta).collect()}
    assert limits == {1: ("ok", 25.0), 2: ("too_long", 2.0), 3: ("no_frames", 10.0), 4: ("no_frames", 25.0)}
    short = sessions.session_limits(frames, meta.drop("frame_total"), max_seconds=0.04)
    assert {r["session_id"]: r["verdict"] for r in short.collect()}[1] == "too_many_frames"


def stream_of(spark, tmp_path):
    for number, part in enumerate((ROWS[:2], ROWS[2:5], ROWS[5:])):
        spark.createDataFrame(part, FRAME).coalesce(1).write.parquet(str(tmp_path / f"in/part={number}"))
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))


def finished(spark, stream, tmp_path, mode="update"):
    query = streams.write_revisions(stream, str(tmp_path / "out"), str(tmp_path / "state"), mode)
    query.awaitTermination()
    assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def test_streamed_summary_equals_the_batch(spark, tmp_path):
    revisions = finished(spark, streams.running_summary(stream_of(spark, tmp_path), NAMES, gap=None), tmp_path)
    latest = streams.latest_rows(revisions, ["session_id"])
    batch = sessions.session_summary(spark.createDataFrame(ROWS, FRAME), NAMES)
    key = lambda r: r["session_id"]
    assert sorted((r.asDict() for r in latest.collect()), key=key) == sorted((r.asDict() for r in batch.collect()), key=key)
    assert revisions.count() > latest.count()


def test_sessions_can_end_by_a_gap(spark, tmp_path):
    stream = streams.running_summary(stream_of(spark, tmp_path), NAMES, gap="1 second")
    revisions = finished(spark, stream, tmp_path, mode="complete")
    last = revisions.where(F.col("revision") == revisions.agg(F.max("revision")).first()[0])
    frames = {}
    for row in last.collect():
        frames.setdefault(row["session_id"], []).append(row["frames_processed"])
    assert sorted(frames[1]) == [3] and sorted(frames[2]) == [1, 2]


@pytest.mark.parametrize("k", [1, 2])  # with 1, a late frame displaces an earlier answer
def test_streamed_first_violations_equal_the_batch(spark, tmp_path, k):
    stream = streams.first_violations(stream_of(spark, tmp_path), k=k)
    revisions = finished(spark, stream, tmp_path)
    found = {(r["session_id"], r["frame"]) for r in streams.latest_groups(revisions, ["session_id"]).collect()}
    meta = spark.createDataFrame([(1, 1.0), (2, 1.0)], "session_id long, fps double")
    batch = sessions.violation_frames(spark.createDataFrame(ROWS, FRAME), meta, k=k)
    assert found == {(r["session_id"], r["frame"]) for r in batch.collect()}


def test_batches_are_bounded_and_complete(spark):
    rows = spark.range(5).coalesce(1)

    def sizes():
        return lambda batch: batch.assign(n=len(batch))

    found = inference.batched_inference(rows, sizes, 2, "id long, n long").collect()
    assert [(r["id"], r["n"]) for r in found] == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 1)]
    with pytest.raises(ValueError):
        inference.batched_inference(rows, sizes, 0, "id long, n long")
    with pytest.raises(Exception, match="results for a batch"):
        inference.batched_inference(rows, lambda: lambda b: b.head(1).assign(n=1), 2, "id long, n long").collect()


def test_model_parameters():
    inference.check_model_parameters(0.25, 512)
    for confidence, size in ((0.0, 512), (1.0, 512), (0.5, 31)):
        with pytest.raises(ValueError):
            inference.check_model_parameters(confidence, size)


def test_pluggable_image_check(spark):
    images = spark.createDataFrame([("a", b"ok"), ("b", b"")], "path string, content binary")
    checked = inference.check_images(images, "path", lambda: lambda contents: contents.map(len) > 0)
    assert checked.columns == ["path", "image_readable"]
    assert {r["path"]: r["image_readable"] for r in checked.collect()} == {"a": True, "b": False}


def test_preview_sample_is_stable(spark):
    rows = [(s, f"/d/{s}/{i}.jpg", True, 0, 2, [2, 0]) for s in ("train", "val", "test") for i in range(3)]
    rows.append(("val", "/d/val/bad.jpg", False, 4, 0, [0, 0]))
    schema = "split string, path string, usable boolean, invalid_lines long, objects long, class_counts array<long>"
    df = spark.createDataFrame(rows, schema)
    sample = preview.sample_preview(df, 2)
    again = preview.sample_preview(df.repartition(5), 2)
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, again.collect()))
    summary = {r["split"]: r for r in preview.preview_summary(df, sample, 2, ["train", "val", "test"]).collect()}
    assert sum(r["images"] for r in summary.values()) == 6
    assert sum(r["objects"] for r in summary.values()) == 12
    assert all(r["average_objects"] == 2.0 and not r["short"] for r in summary.values())
    assert summary["val"]["skipped"] == 1 and summary["val"]["invalid_lines"] == 4
    names = Taxonomy.of(["a", "b"])
    totals = {(r["class_name"], r["split"]): r["objects"] for r in preview.preview_distribution(sample, names).collect()}
    assert totals["a", None] == 12 and totals["b", "val"] == 0
    with pytest.raises(ValueError):
        preview.sample_preview(df, 0)


def test_windows_close_with_the_watermark(spark, tmp_path):
    stream = streams.running_rates(stream_of(spark, tmp_path), width="2 seconds", lateness="1 hour")
    latest = streams.latest_rows(finished(spark, stream, tmp_path), ["window_start", "class_name"])
    batch = sessions.violation_rates(spark.createDataFrame(ROWS, FRAME), "2 seconds")
    assert sorted(map(tuple, latest.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def ticking(spark, folder, *parts):
    for number, part in enumerate(parts):
        spark.createDataFrame(part, FRAME).coalesce(1).write.parquet(str(folder / f"in/part={number}"))
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(str(folder / "in/part=*"))


def test_ended_sessions_are_emitted_once_and_leave_the_state(spark, tmp_path):
    late = frame(1, 1, "no_vest")  # its session has been emitted when it arrives
    stream = ticking(spark, tmp_path, ROWS, [frame(3, 50, "no_vest")], [frame(3, 51)], [late], [frame(4, 900)])
    found = streams.ended_sessions(stream, NAMES, gap="5 seconds", lateness="1 second")
    query = streams.write_revisions(found, str(tmp_path / "out"), str(tmp_path / "state"), "append")
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["session_id"], r["frames_processed"], r["frames_with_violations"]) for r in rows) == [
        (1, 3, 1), (2, 3, 2), (3, 2, 1)
    ]
    assert all((r["ended"] - r["started"]).total_seconds() >= 5 for r in rows)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # session 4 is open


def test_ended_violations_are_emitted_once_and_leave_the_state(spark, tmp_path):
    apart = [frame(1, 30, "no_vest"), frame(1, 31), frame(1, 33, "no_helmet"), frame(1, 32, "no_helmet")]
    stream = ticking(
        spark, tmp_path, ROWS, apart, [frame(3, 500, "no_vest")], [frame(3, 501, "no_vest")],
        [frame(1, 34, "no_vest")], [frame(4, 900, "no_vest")],
    )
    gap = pd.Timedelta(seconds=5).to_pytimedelta()
    found = streams.ended_violations(stream, k=2, gap=gap, lateness="1 second")
    query = streams.write_revisions(found, str(tmp_path / "out"), str(tmp_path / "state"), "append")
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["session_id"], r["frame"]) for r in rows) == [(1, 0), (1, 30), (1, 32), (2, 2), (2, 3), (3, 500), (3, 501)]
    assert {(r["ended"] - pd.Timestamp("2024-01-01")).total_seconds() for r in rows if r["session_id"] == 1} == {5.0, 38.0}
    left = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "state")).collect()
    assert {r["key"]["session_id"] for r in left} == {4}


def test_stretches_join_in_any_order():
    rows = [(0, 0, [(3, "c")]), (10, 10, [(1, "a")]), (5, 5, [(2, "b")]), (20, 20, [(9, "z")])]
    assert streams.merge_stretches(rows, 10, 2) == [(0, 10, [(1, "a"), (2, "b")]), (20, 20, [(9, "z")])]
    for cut in range(1, 4):
        early = streams.merge_stretches(rows[cut:], 10, 2)
        assert streams.merge_stretches(early + rows[:cut], 10, 2) == streams.merge_stretches(rows, 10, 2)


def test_sessions_share_a_state_and_end_by_themselves(spark, tmp_path):
    lost = [frame(None, 6, "no_vest")]
    arrivals = (ROWS, [frame(1, 30, "no_vest"), frame(3, 31, "no_helmet")], lost, [frame(70, 500, "no_vest")], [frame(3, 900, "no_vest")])
    gap = pd.Timedelta(seconds=5).to_pytimedelta()
    found = []
    for together in (1, 64):
        at = tmp_path / str(together)
        at.mkdir()
        stream = streams.ended_violations(ticking(spark, at, *arrivals), k=2, gap=gap, lateness="1 second", together=together)
        streams.write_revisions(stream, str(at / "out"), str(at / "state"), "append").awaitTermination()
        rows = spark.read.parquet(str(at / "out")).select("session_id", "ended", "frame", "violations").collect()
        found.append(sorted(map(repr, rows)))
        left = spark.read.format("statestore").option("stateVarName", "open").load(str(at / "state")).collect()
        assert {r["key"]["session_id"] for r in left} == {3 if together == 1 else 0}
    assert found[0] == found[1] and len(found[0]) > 3
