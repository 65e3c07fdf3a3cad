import json
import time

import pytest
from gridloom.sources.live import live_frames
from gridloom.streaming import stateful
from gridloom.streaming import tracking as T
from test_tracking import moving

DETS = "stream_id long, frame_no long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls int"


def record(root, stream, segment, frames):
    folder = root / f"stream={stream}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f".{segment}").write_text("".join(json.dumps(f) + "\n" for f in frames))
    (folder / f".{segment}").rename(folder / segment)  # appears as a whole


def frame(n, session="a", payload="p"):
    return {"frame_no": n, "session": session, "payload": payload}


def run(spark, path, out, keep="all"):
    q = live_frames(spark, str(path), keep).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").collect()
    return sorted((r["stream_id"], r["frame_no"], not r["gap"], r["session"], r["passed_over"], r["payload"]) for r in rows)


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    root = tmp_path / "in"
    record(root, "1", "0001", [frame(0), frame(1)])
    record(root, "2", "0001", [frame(0, "x", {"k": 1}), frame(1, "y", None)])
    first = run(spark, root, tmp_path)
    assert first == [
        ("1", 0, True, "a", 0, "p"), ("1", 1, True, "a", 0, "p"),
        ("2", 0, True, "x", 0, '{"k": 1}'), ("2", 1, False, "y", 0, None), ("2", 1, True, "y", 0, None),
    ]
    assert run(spark, root, tmp_path) == first  # nothing new
    record(root, "1", "0002", [frame(2)])
    record(root, "1", "0003", [frame(7, "b")])
    record(root, "3", "0001", [frame(0)])
    second = run(spark, root, tmp_path)
    assert [r for r in second if r not in first] == [("1", 2, True, "a", 0, "p"), ("1", 7, False, "b", 0, None), ("1", 7, True, "b", 0, "p"), ("3", 0, True, "a", 0, "p")]
    assert len(second) == len(first) + 4
    batch = live_frames(spark, str(root), stream=False).collect()
    assert sorted((r["stream_id"], r["frame_no"], not r["gap"], r["session"], r["passed_over"], r["payload"]) for r in batch) == second
    record(root, "2", "0002", [frame(2, "z")])  # the session before is that of the last segment read
    assert [r for r in run(spark, root, tmp_path) if r not in second] == [("2", 2, False, "z", 0, None), ("2", 2, True, "z", 0, "p")]


def test_latest_frame_only(spark, tmp_path):
    root = tmp_path / "in"
    record(root, "1", "0001", [frame(k) for k in range(5)])
    record(root, "2", "0001", [frame(3)])
    assert run(spark, root, tmp_path, "latest") == [("1", 4, True, "a", 4, "p"), ("2", 3, True, "a", 0, "p")]
    record(root, "1", "0002", [frame(5), frame(6, "b"), frame(7, "b")])
    assert run(spark, root, tmp_path, "latest")[1:3] == [("1", 7, False, "b", 0, None), ("1", 7, True, "b", 2, "p")]


def test_empty_folder_and_bad_options(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert live_frames(spark, str(tmp_path / "in"), stream=False).count() == 0
    with pytest.raises(Exception, match="latest"):
        live_frames(spark, str(tmp_path / "in"), keep="some", stream=False).count()


@pytest.mark.parametrize("kind", ["byte", "oc", "deep", "cues"])
def test_tracks_survive_as_rows(kind):
    """A tracker that is taken apart into rows after every frame goes on as one that is not."""
    whole, parts, rows, clock = T.tracker(kind), T.tracker(kind), {}, {}
    for f in range(40):
        dets = moving(f, drop=(1,) if 5 <= f < 9 else ())
        want = whole.step(f, dets)
        now = T.tracker(kind)
        if rows or clock:
            vars(now).update(clock)
            now.tracks = [stateful.track_of(k, rows[k], now.aspect) for k in sorted(rows)]
        else:
            now = parts
        assert now.step(f, dets) == want
        rows = {t.id: stateful.track_row(t) for t in now.tracks}
        clock = {k: v for k, v in vars(now).items() if k != "tracks"}


def test_live_tracking_equals_batch_and_forgets(spark, tmp_path):
    rows = [(s, f, *d) for s in range(2) for f in range(60) for d in moving(f % 30, drop=(s,) if f % 7 == 4 else ())]
    dets = spark.createDataFrame(rows, DETS)
    batch = sorted(map(tuple, T.track(dets).collect()))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocks(spark)
    try:
        for k in range(3):
            dets.where(f"frame_no >= {20 * k} and frame_no < {20 * k + 20}").coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
        source = spark.readStream.schema(dets.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = stateful.track_live(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"] and p["numInputRows"]]
        assert sorted(map(tuple, spark.read.schema(T.OUT).parquet(f"{tmp_path}/out").collect())) == batch and batch
        assert len(sizes) == 3 and max(sizes) == sizes[1] <= 16  # as large as the live tracks, however many frames there were
        # A stream that is silent for longer than it may be loses its state.
        source = spark.readStream.schema(dets.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = stateful.track_live(source, idle=0.5).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp2").trigger(processingTime="1 second").start()
        left = None
        for _ in range(60):
            time.sleep(1)
            left = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress and q.lastProgress["stateOperators"] and q.lastProgress["batchId"] > 0 else None
            if left == 0:
                break
        q.stop()
        assert left == 0
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
