"""Streaming counterparts of the batch operators (STR-1..9); those that depend on the order of
events are in ``ordered``.

Every function takes streaming DataFrames (the stateless ones work on both kinds) and
leaves source, trigger and checkpoint to the caller. ``ts`` columns are timestamps.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.features import flag_chunks
from ..operators.reports import AGES_S, DUE_WINDOW_S, job_view
from ..operators.trends import FRESH_S
from ..sinks.keyed import KeyedTable
from .ordered import dealt

# -- sinks --------------------------------------------------------------------------


def write_updates(stream: DataFrame, table: KeyedTable, checkpoint: str, mode: str = "update", gone: str | None = None):
    """Merge each micro-batch of changed rows into a table by key. A batch that is run again after a
    failure finds its number in the table, so every change counts once."""
    def put(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, batch=batch_id, gone=gone)

    return (stream.writeStream.outputMode(mode).foreachBatch(put)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def write_rows(stream: DataFrame, path: str, checkpoint: str, by: list[str] | None = None):
    """Append finished rows to a table, exactly once."""
    out = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (out.partitionBy(*by) if by else out).trigger(availableNow=True).start(path)


# -- STR-1, STR-2 -------------------------------------------------------------------

def latest_stage(events: DataFrame) -> DataFrame:
    """Last event of each (job_id, stage_id) by sequence number."""
    rest = [c for c in events.columns if c not in ("job_id", "stage_id")]
    return (events.groupBy("job_id", "stage_id").agg(F.max_by(F.struct(*rest), "seq").alias("_e"))
            .select("job_id", "stage_id", "_e.*"))


def job_status(feed: DataFrame, clips: DataFrame) -> DataFrame:
    """Current view of each job of a status feed (job_id, status, seq) with its number of
    clips from a table."""
    last = feed.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
    made = clips.groupBy("job_id").agg(F.count("*").alias("_n"))
    return (job_view(last.join(made, "job_id", "left"))
            .withColumn("clips_generated", F.coalesce("_n", F.lit(0))).drop("_n"))


# -- STR-4 --------------------------------------------------------------------------

class _DueTimers(StatefulProcessor):
    """The ages of posts still to come; a look at the statistics near an age strikes it out. A bucket
    of posts has one state (time of its timer, posting time and open ages of each post)."""

    def __init__(self, ages, window):
        self.ages, self.window = sorted(ages), window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.posts = handle.getValueState("posts", "armed bigint, posts binary")

    def _write(self, armed, posts) -> None:
        if not posts:
            self.posts.clear()
            return
        due = min(posted + ages[0][0] for posted, ages in posts.values()) * 1000
        if armed is None or due < armed:
            self.handle.registerTimer(due)
            armed = due
        self.posts.update((armed, pickle.dumps(posts, 5)))

    def _read(self):
        got = self.posts.get()
        return (None, {}) if got is None else (got[0], pickle.loads(got[1]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        armed, posts = self._read()
        looks = []
        for pdf in rows:
            for clip, platform, kind, at in zip(*(pdf[c].tolist() for c in ("clip_id", "platform", "kind", "at_s"))):
                if kind != "post":
                    looks.append(((clip, platform), at))
                elif (clip, platform) not in posts:
                    posts[clip, platform] = (at, [(age, False) for age in self.ages])
        for post, at in looks:
            if post in posts:
                posted, ages = posts[post]
                if any(abs(at - posted - age) <= self.window for age, _ in ages):
                    posts[post] = (posted, [(age, seen or abs(at - posted - age) <= self.window) for age, seen in ages])
        self._write(armed, posts)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        armed, posts = self._read()
        if armed is None or armed >= now:
            return
        left, out = {}, []
        for post, (posted, ages) in posts.items():
            out += [(*post, posted, age) for age, seen in ages if (posted + age) * 1000 < now and not seen]
            ages = [a for a in ages if (posted + a[0]) * 1000 >= now]
            if ages:
                left[post] = (posted, ages)
        self._write(None, left)
        if out:
            yield pd.DataFrame(out, columns=["clip_id", "platform", "posted_at", "age_s"])

    def close(self) -> None:
        pass


DUE_SCHEMA = "clip_id bigint, platform string, posted_at bigint, age_s bigint"


def posts_due_stream(posts: DataFrame, analytics: DataFrame, lateness: str = "1 hour",
                     ages=AGES_S, window: int = DUE_WINDOW_S) -> DataFrame:
    """A row when a post reaches an age without a statistics row near that age.

    Event time is the posting or fetch time; timers fire as the watermark passes. State is
    one small record per open post and ends with the last age.
    """
    both = (posts.select("clip_id", "platform", F.lit("post").alias("kind"), F.col("posted_at").alias("at_s"))
            .unionByName(analytics.select("clip_id", "platform", F.lit("look").alias("kind"), F.col("fetched_at").alias("at_s"))))
    timed = both.withColumn("ts", F.timestamp_seconds("at_s")).withWatermark("ts", lateness)
    due = dealt(timed, ["clip_id", "platform"]).transformWithStateInPandas(
        _DueTimers(ages, window), DUE_SCHEMA.replace("clip_id bigint", "clip_id string"), "Append", "EventTime")
    return due.withColumn("clip_id", F.col("clip_id").cast("bigint"))


# -- STR-5, STR-6 -------------------------------------------------------------------

def daily_views_stream(analytics: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Views per UTC day and platform in tumbling windows; rows later than ``lateness`` are
    dropped and show in the progress metrics."""
    day = F.window("ts", "1 day")
    return (analytics.withWatermark("ts", lateness).groupBy(day.alias("w"), "platform")
            .agg(F.sum("views").alias("views"))
            .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "platform", "views"))


def unseen_messages(messages: DataFrame, seen: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Messages not handled before: not in the table of seen ids, and only once within the
    lateness bound."""
    fresh = messages.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["message_id"])
    return fresh.join(seen.select("message_id"), "message_id", "left_anti")


# -- STR-7 --------------------------------------------------------------------------

def gate_chunks(chunks: DataFrame, guard: str = "default") -> DataFrame:
    """The quality gate per chunk, without state: adds ``reason`` by the rule of the batch."""
    return flag_chunks(chunks, guard)


# -- STR-9 --------------------------------------------------------------------------

def live_trends(snapshots: DataFrame, as_of: int, ttl_s: int = FRESH_S) -> DataFrame:
    """Snapshot rows still within their time to live; on a table partitioned by day whole
    partitions are skipped."""
    out = snapshots.filter(F.col("fetched_at") > as_of - ttl_s)
    if "day" in snapshots.columns:
        out = out.filter(F.col("day") >= (as_of - ttl_s) // 86_400)
    return out
