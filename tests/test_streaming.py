"""Streams fed file by file, compared with their batch counterparts."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentloom.operators.features import flag_chunks
from momentloom.operators import tracking as K
from momentloom.session import stage
from momentloom.sinks.keyed import KeyedTable
from momentloom.streaming import feeds as S
from momentloom.streaming import ordered as O
from test_tracking_captions import DET, clip_rows


@pytest.fixture
def feed(spark, tmp_path):
    """Batches of rows -> a stream that reads one batch per trigger."""
    made = []

    def build(batches, schema):
        path = tmp_path / f"in{len(made)}"
        made.append(path)
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / f"b{i:03}"))
            for file in (path / f"b{i:03}").iterdir():      # files are read in the order of their times
                os.utime(file, (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))
        full = spark.createDataFrame([], schema).schema
        return spark.readStream.schema(full).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(path / "*"))
    return build


def finish(spark, df, tmp_path, name="out"):
    S.write_rows(df, str(tmp_path / name), str(tmp_path / f"{name}_chk")).awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


def settle(spark, df, tmp_path, keys, gone=None):
    table = KeyedTable(spark, str(tmp_path / "up"), T.StructType([f for f in df.schema if f.name != gone]), keys, buckets=4)
    S.write_updates(df, table, str(tmp_path / "up_chk"), gone=gone).awaitTermination()
    return table.read()


def test_latest_stage_over_batches(spark, feed, tmp_path, rows):
    ev = feed([[(1, "rank", 1, "a"), (1, "post", 2, "b")], [(1, "rank", 5, "c"), (2, "rank", 4, "d")], [(1, "rank", 3, "late")]],
              "job_id bigint, stage_id string, seq bigint, note string")
    got = settle(spark, S.latest_stage(ev), tmp_path, ["job_id", "stage_id"])
    assert rows(got) == [(1, "post", 2, "b"), (1, "rank", 5, "c"), (2, "rank", 4, "d")]


def test_job_status(spark, feed, tmp_path, rows):
    ev = feed([[(1, "pending", 1)], [(1, "done", 2), (2, "failed", 3)]], "job_id bigint, status string, seq bigint")
    clips = spark.createDataFrame([(1,), (1,)], "job_id bigint")
    got = settle(spark, S.job_status(ev, clips), tmp_path, ["job_id"])
    assert rows(got, "job_id", "view_status", "progress", "clips_generated") == [(1, "done", 100, 2), (2, "failed", 0, 0)]


STAGE = "job_id bigint, stage_id string, kind string, at_ms bigint, seq bigint"


def run(df, tmp_path, name="out"):
    """The finished query of an appending stream."""
    q = S.write_rows(df, str(tmp_path / name), str(tmp_path / f"{name}_chk"))
    q.awaitTermination()
    return q


def test_stage_durations_across_batches(spark, feed, tmp_path, rows):
    ev = feed([[(1, "rank", "enter", 100, 1)], [(1, "rank", "enter", 150, 2), (1, "rank", "exit", 400, 3), (1, "rank", "exit", 500, 4)],
               [(2, "rank", "exit", 9, 5)], [(9, "end", "exit", 10_000, 6)]], STAGE)
    assert rows(finish(spark, O.stage_durations(ev, "5 seconds"), tmp_path)) == [(1, "rank", 150, 400, 250)]


def test_stage_durations_pair_by_time_and_leave_no_state(spark, feed, tmp_path, rows):
    """Entry and exit come in swapped batches; one entry is never left; one event is late."""
    h = 3_600_000
    ev = feed([[(1, "a", "exit", 900, 2), (2, "a", "enter", 50, 3), (3, "a", "exit", 20, 9)], [(1, "a", "enter", 300, 1), (3, "a", "enter", 20, 8)],
               [(4, "x", "exit", h, 4)], [(4, "x", "exit", h + 1, 10)], [(1, "a", "enter", 400, 5)], [(4, "x", "exit", 40 * h, 6)], [(4, "x", "exit", 100 * h, 7)]], STAGE)
    q = run(O.stage_durations(ev, "10 minutes", ttl_ms=2 * h), tmp_path)
    got = spark.read.schema(O.DURATION_SCHEMA).parquet(str(tmp_path / "out"))
    assert rows(got) == [(1, "a", 300, 900, 600), (3, "a", 20, 20, 0)]
    assert O.late_rows(q) == 1
    state = spark.read.format("state-metadata").load(str(tmp_path / "out_chk")).collect()
    assert len(state) == 1
    for name in ("waiting", "entered"):
        left = spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "out_chk"))
        keys = {tuple(r.key) for r in left.select("key").collect()}
        assert keys <= {(4, "x")}, (name, keys)     # only what lies behind the watermark


def test_due_timers(spark, feed, tmp_path, rows):
    h, z = 3600, 1_000_000
    posts = feed([[(1, "x", z), (2, "x", z)]], "clip_id bigint, platform string, posted_at bigint")
    looks = feed([[(9, "x", z)], [(2, "x", z + 23 * h)], [(9, "x", z + 30 * h)], [(9, "x", z + 200 * h)], [(9, "x", z + 300 * h)]],
                 "clip_id bigint, platform string, fetched_at bigint")
    got = finish(spark, S.posts_due_stream(posts, looks), tmp_path)
    assert set(rows(got)) == {(1, "x", z, 24 * h), (1, "x", z, 72 * h), (2, "x", z, 72 * h)}


def test_daily_views_drop_late_rows(spark, feed, tmp_path, rows):
    d = 86_400
    # Lateness is judged by the watermark of the batch before.
    batches = [[(0, "x", 5)], [(5 * d, "x", 7)], [(5 * d, "x", 1)], [(0, "x", 100)]]
    ev = feed(batches, "at bigint, platform string, views bigint").withColumn("ts", F.timestamp_seconds("at"))
    got = settle(spark, S.daily_views_stream(ev), tmp_path, ["day", "platform"])
    assert rows(got) == [("1970-01-01", "x", 5), ("1970-01-06", "x", 8)]


def test_messages_once(spark, feed, tmp_path, rows):
    ev = feed([[(1, 0), (1, 0), (2, 5)], [(1, 9), (3, 10)]], "message_id bigint, at bigint").withColumn("ts", F.timestamp_seconds("at"))
    seen = spark.createDataFrame([(2,)], "message_id bigint")
    assert rows(finish(spark, S.unseen_messages(ev, seen), tmp_path), "message_id") == [(1,), (3,)]


def test_gate_is_the_batch_gate(spark, feed, tmp_path, rows):
    data = [(1, 0, "Thank you very much. " * 5, 20, 10.0), (1, 1, "fine words here", 3, 2.0), (1, 2, "สวัสดี", 1, 1.0),
            (1, 3, "text without a word list", 0, 9000.0), (1, 4, "thin", 1, 9000.0)]
    schema = "episode_id bigint, chunk_idx bigint, text string, n_words bigint, duration_s double"
    got = finish(spark, S.gate_chunks(feed([data], schema)), tmp_path)
    want = rows(flag_chunks(spark.createDataFrame(data, schema)), "chunk_idx", "reason")
    assert rows(got, "chunk_idx", "reason") == want
    assert want == [(0, "repeated-3-gram"), (1, None), (2, "foreign-script"), (3, None), (4, "density")]


TIMED = DET + ", ts timestamp"


def timed(rows):
    from datetime import datetime, timezone
    return [(*r, datetime.fromtimestamp(r[1] * 1000 + r[2] * 0.25, timezone.utc)) for r in rows]


def swapped_clips():
    """Two clips in batches, frames of neighbouring batches mixed up, and a last frame long after."""
    data = clip_rows(4, 1, 40) + clip_rows(5, 2, 40)
    cuts = [[d for d in data if d[2] in at] for at in ([0, 1, 5, 3], [2, 4, 6, 7, 9], [11, 10, 8], list(range(12, 40)))]
    end = [(9, 9_000_000, 0, 0, 0, 1.0, 1.0, 2.0, 2.0, 0.5)]
    return data, [timed(c) for c in cuts if c] + [timed(end)]


def test_tracking_by_batches_equals_tracking_at_once(spark, feed, tmp_path):
    data, batches = swapped_clips()
    got = finish(spark, O.track_stream(feed(batches, TIMED), 60.0, lateness="1 hour"), tmp_path)
    once = K.track_nn(spark.createDataFrame(data, DET), 60.0)
    a = sorted((r.clip_id, r.frame_idx, r.det_idx, r.track_id) for r in got.collect())
    b = sorted((r.clip_id, r.frame_idx, r.det_idx, r.track_id) for r in once.collect())
    assert a == b and b


@pytest.mark.parametrize("hold", [1, 2, 3])
def test_tracker_and_hold_chained_equal_the_batch_rules(spark, feed, tmp_path, hold):
    data, batches = swapped_clips()
    q = run(O.hold_stream(O.track_stream(feed(batches, TIMED), 60.0, lateness="1 hour"), hold), tmp_path)
    assert len(q.lastProgress["stateOperators"]) == 2 and O.late_rows(q) == 0
    got = sorted(tuple(r) for r in spark.read.schema(O.HELD_SCHEMA).parquet(str(tmp_path / "out")).collect())
    tracks = stage(K.track_nn(spark.createDataFrame(data, DET), 60.0), "tracks")
    best = F.max_by(F.struct("track_id", *K.BOX), F.struct("conf", "det_idx"))
    won = tracks.groupBy(*K.FRAME).agg(F.first("t_ms").alias("t_ms"), best.alias("_w")).select(*K.FRAME, "t_ms", "_w.*")
    want = sorted(tuple(r) for r in K.hold_speaker(won, tracks, hold).select("clip_id", "frame_idx", "track_id", *K.BOX).collect())
    assert got == want and want


def test_a_frame_behind_the_watermark_is_dropped_and_counted(spark, feed, tmp_path):
    data = [d for d in clip_rows(4, 1, 12)]
    late = [d for d in data if d[2] == 3]
    batches = [timed([d for d in data if d[2] != 3 and d[2] < 8]), timed([(8, 50_000, 0, 0, 0, 1.0, 1.0, 2.0, 2.0, 0.5)]), timed(late), timed([d for d in data if d[2] >= 8])]
    q = run(O.track_stream(feed(batches, TIMED), 60.0, lateness="1 minute"), tmp_path)
    assert O.late_rows(q) == len(late) + len([d for d in data if d[2] >= 8])


def test_clips_and_topics_share_state(spark, feed, tmp_path):
    """As many values of state as buckets at most, however many keys there are."""
    data = timed([d for i in range(60) for d in clip_rows(i, 1, 2)])
    q = run(O.track_stream(feed([data], TIMED), 60.0, lateness="1 hour"), tmp_path)
    assert len({r.key for r in spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "out_chk")).collect()}) <= 60
    assert spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "out_chk")).schema["key"].dataType.names == ["bucket"]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < len(data)


def test_topics_leave_when_their_day_is_over(spark, feed, tmp_path, rows):
    h = 3_600
    schema = "source string, topic_id string, label string, score double, fetched_at bigint"
    steps = [[("g", "a", "first", 1.0, 10 * h), ("g", "b", "b", 1.0, 12 * h)], [("g", "a", "second", 2.0, 30 * h)], [("x", "c", "c", 1.0, 40 * h)], [("x", "end", "e", 1.0, 60 * h)], [("x", "end", "e", 1.0, 61 * h)]]
    table = settle(spark, O.live_topics(feed(steps[:3], schema)), tmp_path, ["source", "topic_id"], gone="gone")
    assert rows(table, "topic_id", "label") == [("a", "second")]        # b has left at 36 h; c is not settled yet
    later = settle(spark, O.live_topics(feed(steps, schema)), tmp_path / "later", ["source", "topic_id"], gone="gone")
    assert rows(later, "topic_id", "label") == [("c", "c")]             # a has left at 54 h


def test_live_trends(spark, tmp_path):
    t = spark.createDataFrame([("a", 100, 0), ("a", 90_000, 1), ("a", 200_000, 2)], "source string, fetched_at bigint, day bigint")
    t.write.partitionBy("day").parquet(str(tmp_path / "t"))
    live = S.live_trends(spark.read.parquet(str(tmp_path / "t")), 200_000)
    assert live.count() == 1
