"""Streams whose state depends on the order of events (STR-3, STR-8, STR-9).

Rows may come in any order, within a batch and from batch to batch. Each operator holds them as
state until the watermark has passed them and then takes them in order of their time; a timer
calls it. Rows later than the watermark are dropped by Spark and counted (``late_rows``).
State ends by timers too: an entry never left, a clip without frames, a topic whose day is over.

Every call for state is a message between Python and the JVM, so state is read and written whole,
once a call, and small keys share it: clips and topics are dealt into ``BUCKETS`` by a hash, and a
bucket has one value of waiting rows, one of open keys and one timer.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import match_nearest
from ..operators.trends import FRESH_S

HOUR_MS = 3_600_000
#: Groups of keys that share state. A batch rewrites the open state of the buckets it touches.
BUCKETS = 4096


def dealt(stream: DataFrame, keys: list[str], buckets: int = BUCKETS):
    """``stream`` grouped by a hash of ``keys``; these become text, so that a missing key in a bucket
    does not turn its whole numbers into fractions."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
    return stream.select(bucket, *[F.col(c).cast("string").alias(c) if c in keys else F.col(c) for c in stream.columns]).groupBy("bucket")


def at_ms(ts: str) -> Column:
    """Milliseconds of a timestamp; a started one counts."""
    return F.floor((F.unix_micros(ts) + 999) / 1000).alias("at")


def late_rows(query) -> int:
    """Rows that came behind the watermark and were dropped, over all batches of a query."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


class _Ordered(StatefulProcessor):
    """Hands the rows of a group on in order, key by key.

    ``keys`` name the parts of a key, ``fields`` what a row holds, by whose first ``order`` its rows
    are sorted; the first is its time in ms. Of rows equal in these the last one counts. ``take``
    gets the state of a key (None: none) and its rows, writes results and returns the new state;
    ``ends`` says when a state is over, ``end`` writes what is left to say then.
    """

    keys: list[str] = []
    fields: list[str] = []
    order = 2
    state = "open"
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "armed bigint, rows binary")
        self.opened = handle.getValueState(self.state, "armed bigint, keys binary")

    @staticmethod
    def _read(value, none):
        """(time of its timer, content) of a state."""
        got = value.get()
        return (None, none) if got is None else (got[0], pickle.loads(got[1]))

    def _write(self, value, armed, due, content) -> None:
        """Store ``content`` with a timer at or before ``due``; without content the state ends. A timer
        that comes early finds nothing to do and is set again."""
        if not content:
            value.clear()
            return
        if armed is None or due < armed:
            self.handle.registerTimer(due)
            armed = due
        value.update((armed, pickle.dumps(content, 5)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        armed, held = self._read(self.waiting, [])
        n, names = len(self.keys), [*self.keys, *self.fields]
        for pdf in rows:
            # Key, then what it is sorted by, then the rest.
            held += [(r[:n], r[n:]) for r in zip(*(pdf[c].tolist() for c in names))]
        if held:
            self._write(self.waiting, armed, min(r[1][0] for r in held), held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        armed, held = self._read(self.waiting, [])
        due, known = self._read(self.opened, {})
        # Timers behind the watermark all fire in this batch; the first call does the work of all.
        spent, over = armed is not None and armed < now, due is not None and due < now
        if not spent and not over:
            return
        passed, left, out = {}, [], []
        for k, r in held:
            if r[0] < now:
                passed.setdefault(k, {})[r[:self.order]] = r
            else:
                left.append((k, r))
        if spent:
            self._write(self.waiting, None, min((r[0] for _, r in left), default=None), left)
        for k, mine in passed.items():
            state = self.take(k, known.pop(k, None), [mine[at] for at in sorted(mine)], now, out)
            if state is not None:
                known[k] = state
        for k in [k for k, state in known.items() if self.ends(state) < now]:
            self.end(k, known.pop(k), out)
        if passed or over:
            self._write(self.opened, None if over else due, min(map(self.ends, known.values()), default=None), known)
        if out:
            yield self.frame(dict(zip(self.columns, map(list, zip(*out)))))

    def frame(self, columns: dict[str, list]) -> pd.DataFrame:
        return pd.DataFrame(columns)

    def end(self, key, state, out) -> None:
        pass

    def close(self) -> None:
        pass


# -- STR-3 --------------------------------------------------------------------------


class _StageTimes(_Ordered):
    """The last entry of a (job, stage) until its exit, for at most ``ttl`` ms."""

    keys, fields, state = ["job_id", "stage_id"], ["at_ms", "seq", "kind"], "entered"
    columns = ["job_id", "stage_id", "entered_ms", "left_ms", "duration_ms"]

    def __init__(self, ttl: int):
        self.ttl = ttl

    def ends(self, entered):
        return entered + self.ttl

    def take(self, key, entered, rows, now, out):
        for at, _, kind in rows:
            if entered is not None and at - entered >= self.ttl:
                entered = None
            if kind == "enter":
                entered = at
            elif entered is not None:
                out.append((*key, entered, at, at - entered))
                entered = None
        return entered


DURATION_SCHEMA = "job_id bigint, stage_id string, entered_ms bigint, left_ms bigint, duration_ms bigint"


def stage_durations(events: DataFrame, lateness: str = "1 hour", ttl_ms: int = 7 * 24 * HOUR_MS) -> DataFrame:
    """Time from entry to exit per (job_id, stage_id) of events (kind, at_ms, seq).

    Events are paired in order of (at_ms, seq), whatever the batch they come in; a second entry
    replaces the first, an exit without entry is nothing. A pair comes out when the watermark has
    passed its exit. An entry not left for ``ttl_ms`` is forgotten, with its state.
    """
    timed = events.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", lateness)
    return timed.groupBy("job_id", "stage_id").transformWithStateInPandas(_StageTimes(ttl_ms), DURATION_SCHEMA, "Append", "EventTime")


# -- STR-8 --------------------------------------------------------------------------


_BOX = ["x1", "y1", "x2", "y2"]


class _Tracker(_Ordered):
    """Nearest-centre tracking of clips: of each the time and number of the last frame, the next id
    and the last frame's faces."""

    keys, fields, order = ["clip_id"], ["at", "frame_idx", "det_idx", "conf", *_BOX], 3
    columns = ["clip_id", "ts", "frame_idx", "det_idx", "track_id", "conf", *_BOX]

    def __init__(self, reach: float, ttl: int):
        self.reach, self.ttl = reach, ttl

    def ends(self, state):
        return state[0] + self.ttl

    def take(self, key, state, rows, now, out):
        last, frame, fresh, seen = state or (None, None, 0, [])
        for at_frame, boxes in groupby(rows, lambda r: r[1]):
            boxes = sorted(boxes, key=lambda b: (-b[3], b[2]))
            if frame is not None and at_frame != frame + 1:
                seen = []
            centers = [((b[4] + b[6]) / 2.0, (b[5] + b[7]) / 2.0) for b in boxes]
            named = {}
            if seen:
                pairs, left = match_nearest(seen, centers, self.reach)
                named.update(pairs)
            else:
                left = range(len(boxes))
            for j in left:
                named[j] = fresh
                fresh += 1
            seen, frame, last = [(named[j], c) for j, c in enumerate(centers)], at_frame, boxes[0][0]
            out.extend((key[0], b[0], b[1], b[2], named[j], *b[3:]) for j, b in enumerate(boxes))
        return last, frame, fresh, seen

    def frame(self, columns):
        return pd.DataFrame({**columns, "ts": pd.to_datetime(columns["ts"], unit="ms", utc=True)})


TRACK_SCHEMA = ("clip_id bigint, ts timestamp, frame_idx bigint, det_idx bigint, track_id bigint, conf double, "
                "x1 double, y1 double, x2 double, y2 double")


def track_stream(detections: DataFrame, distance: float = 200.0, lateness: str = "5 seconds", ttl_ms: int = HOUR_MS) -> DataFrame:
    """Track ids of boxes (clip_id, ts, frame_idx, det_idx, conf, x1..y2) as the watermark passes them.

    ``ts`` is the time a frame was taken, equal for its boxes and rising with frame_idx. Frames come
    in any order within ``lateness``; a frame behind the watermark is dropped and counted. A clip
    without frames for ``ttl_ms`` is over: its state goes, and later frames would begin at 0 again.
    """
    timed = detections.withWatermark("ts", lateness).select("ts", at_ms("ts"), "clip_id", "frame_idx", "det_idx", *[F.col(c).cast("double").alias(c) for c in ("conf", *_BOX)])
    tracks = dealt(timed, ["clip_id"]).transformWithStateInPandas(_Tracker(distance, ttl_ms), TRACK_SCHEMA.replace("clip_id bigint", "clip_id string"), "Append", "EventTime", eventTimeColumnName="ts")
    return tracks.withColumn("clip_id", F.col("clip_id").cast("bigint"))


class _Holder(_Ordered):
    """The held track of clips: of each its last box, and the challenger with its frames in a row."""

    keys, fields, order = ["clip_id"], ["at", "frame_idx", "det_idx", "track_id", "conf", *_BOX], 3
    columns = ["clip_id", "frame_idx", "track_id", *_BOX]

    def __init__(self, hold: int, ttl: int):
        self.hold, self.ttl = hold, ttl

    def ends(self, state):
        return state[0] + self.ttl

    def take(self, key, state, rows, now, out):
        last, frame, track, rival, streak, box = state or (None, None, None, None, 0, None)
        for at_frame, boxes in groupby(rows, lambda r: r[1]):
            boxes = list(boxes)
            if frame is not None and at_frame != frame + 1:
                rival, streak = None, 0
            win = max(boxes, key=lambda b: (b[4], b[2]))[3]
            if track is None or win == track:
                track, rival, streak = win if track is None else track, None, 0
            else:
                streak = streak + 1 if rival == win else 1
                rival = win
                if streak >= self.hold:
                    track, rival, streak = win, None, 0
            box = next((b[5:9] for b in boxes if b[3] == track), box)
            frame, last = at_frame, boxes[0][0]
            out.append((key[0], frame, track, *box))
        return last, frame, track, rival, streak, box


HELD_SCHEMA = "clip_id bigint, frame_idx bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double"


def hold_stream(tracks: DataFrame, hold: int = 3, ttl_ms: int = HOUR_MS) -> DataFrame:
    """Held track and its last box per frame of ``track_stream``, in the same query.

    The surest box of a frame (the later one of equally sure) wins it. The first winner is taken at
    once; another takes over when it has won ``hold`` frames in a row. A frame left out breaks a row.
    """
    timed = tracks.select("ts", at_ms("ts"), "clip_id", "frame_idx", "det_idx", "track_id", "conf", *_BOX)
    held = dealt(timed, ["clip_id"]).transformWithStateInPandas(_Holder(hold, ttl_ms), HELD_SCHEMA.replace("clip_id bigint", "clip_id string"), "Append", "EventTime")
    return held.withColumn("clip_id", F.col("clip_id").cast("bigint"))


# -- STR-9 --------------------------------------------------------------------------


class _LiveTopic(_Ordered):
    """The newest row of a topic until its time is over."""

    keys, fields, order = ["source", "topic_id"], ["at", "label", "score"], 1
    columns = ["source", "topic_id", "label", "score", "fetched_at", "gone"]

    def __init__(self, ttl: int):
        self.ttl = ttl

    def ends(self, newest):
        return newest + self.ttl

    def take(self, key, newest, rows, now, out):
        at, label, score = rows[-1]
        if self.ends(at) >= now:
            out.append((*key, label, score, at // 1000, False))
        return at

    def end(self, key, newest, out):
        out.append((*key, None, None, newest // 1000, True))


LIVE_SCHEMA = "source string, topic_id string, label string, score double, fetched_at bigint, gone boolean"


def live_topics(snapshots: DataFrame, lateness: str = "1 hour", ttl_s: int = FRESH_S) -> DataFrame:
    """Changes of the live set of (source, topic_id): the newest row, or ``gone`` when a topic has had
    no row for ``ttl_s``. ``snapshots``: source, topic_id, label, score, fetched_at (seconds).

    The clock is the watermark. Merge the changes into a ``KeyedTable`` with ``gone="gone"``; the
    table then holds the live topics.
    """
    timed = snapshots.withColumn("ts", F.timestamp_seconds("fetched_at")).withWatermark("ts", lateness).select(
        "ts", (F.col("fetched_at") * 1000).alias("at"), "source", "topic_id", "label", F.col("score").cast("string").alias("score"))
    # A score goes as text, in which a missing one and one that is no number differ.
    changes = dealt(timed, ["source", "topic_id"]).transformWithStateInPandas(_LiveTopic(ttl_s * 1000), LIVE_SCHEMA.replace("score double", "score string"), "Update", "EventTime")
    return changes.withColumn("score", F.col("score").cast("double"))
