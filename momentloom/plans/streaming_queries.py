"""STR-1..9 run over the given tables as streams, up to the data now available. What a
stream has settled on by then is what the batch rule says, so SQL can check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from ..sinks.keyed import KeyedTable
from ..streaming import feeds as S
from ..streaming import ordered as O
from . import tables as t
from .catalog import query
from .tables import sql
from .timeline_queries import QLT1, qlt1_chunks
from .tracking_queries import TRACK_NN, boxes_of

NOW = 1_705_708_800


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a file stream."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # As a glob, a table may be one file or a folder of files.
    df = spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")
    zoneless = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def rocks(spark):
    """Stateful Python operators keep their state in RocksDB."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def settle(spark, df, name, keys, gone=None) -> DataFrame:
    """Run an updating stream to its end and read the current rows."""
    base = shared_dir(spark, name)
    fields = [f for f in df.schema.fields if f.name != gone]
    table = KeyedTable(spark, f"{base}/out", T.StructType(fields), keys, buckets=8)
    S.write_updates(df, table, f"{base}/chk", gone=gone).awaitTermination()
    return table.read()


def finish(spark, df, name) -> DataFrame:
    """Run an appending stream to its end and read its rows."""
    base = shared_dir(spark, name)
    S.write_rows(df, f"{base}/out", f"{base}/chk").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def stage_events(spark, sf):
    return stream(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_type").alias("stage_id"), F.col("event_id").alias("seq"),
        F.unix_millis("ts").alias("at_ms"), "value")


@query("str_01_latest_stage", """SELECT user_id AS job_id, event_type AS stage_id, event_id AS seq, value FROM (SELECT *,
   row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def str1(spark, sf):
    rocks(spark)
    out = settle(spark, S.latest_stage(stage_events(spark, sf)), "latest_stage", ["job_id", "stage_id"])
    return out.select("job_id", "stage_id", "seq", "value")


@query("str_02_job_status", sql("""SELECT u AS job_id, view_status, progress, coalesce(n, 0) AS clips_generated FROM (SELECT user_id AS u, event_id,
   CASE event_type WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'rendering' END AS view_status,
   CASE event_type WHEN 'view' THEN 5 WHEN 'purchase' THEN 100 WHEN 'error' THEN 0 WHEN 'click' THEN 40 ELSE 65 END AS progress,
   row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) LEFT JOIN (SELECT job_id, count(*) AS n FROM clips GROUP BY ALL) ON job_id = u
   WHERE rn = 1""", "clips"))
def str2(spark, sf):
    rocks(spark)
    k = F.col("event_type")
    status = (F.when(k == "view", "pending").when(k == "purchase", "done").when(k == "error", "failed")
              .when(k == "click", "transcribed").otherwise("ranked"))
    feed = stream(spark, sf, "events").select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("event_id").alias("seq"))
    out = settle(spark, S.job_status(feed, t.clips(spark, sf)), "job_status", ["job_id"])
    return out.select("job_id", "view_status", "progress", "clips_generated")


@query("str_03_stage_durations", """WITH e AS (SELECT user_id AS job_id, 's' || (event_id % 3) AS stage_id, event_id, epoch_us(ts) // 1000 AS ms,
     CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'enter' ELSE 'exit' END AS kind FROM events),
   p AS (SELECT *, lag(kind) OVER w AS k0, lag(ms) OVER w AS a0 FROM e WHERE ms < (SELECT max(ms) - 3600000 FROM e)
     WINDOW w AS (PARTITION BY job_id, stage_id ORDER BY ms, event_id))
   SELECT job_id, stage_id, a0 AS entered_ms, ms AS left_ms, ms - a0 AS duration_ms FROM p WHERE kind = 'exit' AND k0 = 'enter' AND ms - a0 < 604800000""")
def str3(spark, sf):
    """What the watermark, an hour behind the last event, has settled."""
    rocks(spark)
    kind = F.when(F.col("event_type").isin("view", "click", "purchase"), "enter").otherwise("exit")
    ev = stream(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), F.concat(F.lit("s"), F.col("event_id") % 3).alias("stage_id"), kind.alias("kind"),
        F.unix_millis("ts").alias("at_ms"), F.col("event_id").alias("seq"))
    return finish(spark, O.stage_durations(ev), "stage_durations")


@query("str_04_posts_due", sql("""SELECT p.clip_id, p.platform, p.posted_at, CAST(a.age AS BIGINT) AS age_s FROM p, (VALUES (86400), (259200)) a(age)
   WHERE p.posted_at + age <= (SELECT max(fetched_at) - 3600 FROM stats) AND NOT EXISTS (SELECT 1 FROM stats s WHERE s.clip_id = p.clip_id AND s.platform = p.platform
     AND s.fetched_at <> p.posted_at AND abs(s.fetched_at - p.posted_at - age) <= 10800)""", "stats",
                               extra="p AS (SELECT clip_id, platform, min(fetched_at) AS posted_at FROM stats GROUP BY ALL)"))
def str4(spark, sf):
    rocks(spark)
    first = t.analytics(spark, sf).groupBy("clip_id", "platform").agg(F.min("fetched_at").alias("posted_at"))
    platform = F.col("event_type")
    for kind, name in t.PLATFORM_OF.items():
        platform = F.when(F.col("event_type") == kind, name).otherwise(platform)
    rows = stream(spark, sf, "events").select(F.col("user_id").alias("clip_id"), platform.alias("platform"),
                                              F.unix_seconds("ts").alias("fetched_at")).join(first, ["clip_id", "platform"])
    posts = rows.filter(F.col("fetched_at") == F.col("posted_at"))
    looks = rows.filter(F.col("fetched_at") != F.col("posted_at"))
    return finish(spark, S.posts_due_stream(posts, looks), "posts_due")


@query("str_05_daily_views", sql("""SELECT strftime(make_timestamp(fetched_at * 1000000), '%Y-%m-%d') AS day, platform, CAST(sum(views) AS BIGINT) AS views
   FROM stats GROUP BY ALL""", "stats"))
def str5(spark, sf):
    rocks(spark)
    platform = F.col("event_type")
    for kind, name in t.PLATFORM_OF.items():
        platform = F.when(F.col("event_type") == kind, name).otherwise(platform)
    rows = stream(spark, sf, "events").select("ts", platform.alias("platform"), F.floor(F.col("value") * 100).cast("bigint").alias("views"))
    return settle(spark, S.daily_views_stream(rows), "daily_views", ["day", "platform"])


@query("str_06_unseen_messages", """SELECT DISTINCT CAST(user_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS BIGINT) AS message_id FROM events
   WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def str6(spark, sf):
    rocks(spark)
    ident = (F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("bigint")).alias("message_id")
    rows = stream(spark, sf, "events").select(ident, "ts")
    seen = t.read(spark, sf, "supplier").select(F.explode(F.sequence(F.col("s_suppkey") * 100, F.col("s_suppkey") * 100 + 99)).alias("message_id"))
    return finish(spark, S.unseen_messages(rows, seen), "unseen").select("message_id")


@query("str_07_gate_chunks", QLT1)
def str7(spark, sf):
    d = stream(spark, sf, "documents").select(F.col("doc_id").alias("episode_id"), "text")
    return finish(spark, S.gate_chunks(qlt1_chunks(d)).select("episode_id", "reason"), "gate")


def box_stream(spark, sf):
    """Boxes as they are taken: an order begins at the second of its number."""
    boxes = boxes_of(stream(spark, sf, "lineitem"))
    return boxes.withColumn("ts", F.timestamp_millis(F.col("clip_id") * 1000 + F.col("t_ms")))


# Boxes the watermark, five seconds behind the last, has settled.
_SETTLED = ", settled AS (SELECT clip_id, frame_idx FROM dets WHERE clip_id * 1000 + t_ms < (SELECT max(clip_id * 1000 + t_ms) - 5000 FROM dets) GROUP BY ALL)"
_TRACKED = TRACK_NN[:TRACK_NN.rindex("SELECT clip_id, frame_idx, det_idx, id AS track_id")]


@query("str_08_track_stream", "WITH RECURSIVE " + _TRACKED + _SETTLED + """
   SELECT clip_id, frame_idx, det_idx, id AS track_id FROM walk JOIN settled USING (clip_id, frame_idx)""")
def str8(spark, sf):
    rocks(spark)
    return finish(spark, O.track_stream(box_stream(spark, sf), 25.0), "tracks").select("clip_id", "frame_idx", "det_idx", "track_id")


# The surest box of a frame wins it; a challenger needs two frames in a row.
_HELD = _TRACKED + _SETTLED + """, el AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS i FROM (SELECT w.clip_id, w.frame_idx, arg_max(w.id, d.conf * 1e15 + d.det_idx) AS win
     FROM walk w JOIN dets d ON d.clip_id = w.clip_id AND d.frame_idx = w.frame_idx AND d.det_idx = w.det_idx JOIN settled s ON s.clip_id = w.clip_id AND s.frame_idx = w.frame_idx
     GROUP BY ALL)),
   hold AS (SELECT clip_id, frame_idx, i, win AS held, NULL::BIGINT AS rival, 0 AS streak FROM el WHERE i = 1
     UNION ALL SELECT clip_id, frame_idx, i, CASE WHEN win <> held AND s >= 2 THEN win ELSE held END, CASE WHEN win <> held AND s < 2 THEN win END, CASE WHEN win <> held AND s < 2 THEN s ELSE 0 END
     FROM (SELECT e.clip_id, e.frame_idx, e.i, e.win, h.held, CASE WHEN e.frame_idx = h.frame_idx + 1 AND h.rival = e.win THEN h.streak + 1 ELSE 1 END AS s
       FROM hold h JOIN el e ON e.clip_id = h.clip_id AND e.i = h.i + 1))"""


@query("str_08_hold_stream", "WITH RECURSIVE " + _HELD + " SELECT clip_id, frame_idx, held AS track_id FROM hold")
def str8_hold(spark, sf):
    """Tracker and hold smoothing, chained in one query."""
    rocks(spark)
    held = O.hold_stream(O.track_stream(box_stream(spark, sf), 25.0), hold=2)
    return finish(spark, held, "held").select("clip_id", "frame_idx", "track_id")


@query("str_09_live_trends", f"""SELECT event_id, event_type AS source, CAST(floor(epoch(ts)) AS BIGINT) AS fetched_at FROM events
   WHERE CAST(floor(epoch(ts)) AS BIGINT) > {NOW} - 86400""")
def str9(spark, sf):
    rocks(spark)
    base = shared_dir(spark, "trends")
    at = F.unix_seconds("ts")
    rows = stream(spark, sf, "events").select("event_id", F.col("event_type").alias("source"), at.alias("fetched_at"), F.floor(at / 86_400).alias("day"))
    S.write_rows(rows, f"{base}/out", f"{base}/chk", ["source", "day"]).awaitTermination()
    return S.live_trends(spark.read.parquet(f"{base}/out"), NOW).select("event_id", "source", "fetched_at")


@query("str_09_live_topics", """WITH e AS (SELECT event_type AS source, 't' || user_id AS topic_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)
   SELECT source, topic_id, max(sec) AS fetched_at FROM e WHERE sec < (SELECT max(sec) - 3600 FROM e) GROUP BY ALL HAVING max(sec) + 86400 >= (SELECT max(sec) - 3600 FROM e)""")
def str9_topics(spark, sf):
    """The topics live at the watermark, an hour behind the last event; others have left the table."""
    rocks(spark)
    at = F.unix_seconds("ts")
    rows = stream(spark, sf, "events").select(F.col("event_type").alias("source"), F.concat(F.lit("t"), F.col("user_id")).alias("topic_id"),
                                              F.lit("topic").alias("label"), F.col("value").cast("double").alias("score"), at.alias("fetched_at"))
    return settle(spark, O.live_topics(rows), "live_topics", ["source", "topic_id"], gone="gone").select("source", "topic_id", "fetched_at")
