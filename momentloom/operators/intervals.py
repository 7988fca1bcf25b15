"""Interval algebra on recording timelines (INT-1..19).

Times are integer milliseconds (``*_ms``); every table carries ``episode_id``. Intervals
are half-open. All keys are (episode, timeline block), never the episode alone, wherever
rows of one episode would otherwise meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import as_col, clamp_chars, fixed, tokens, trim_ws
from ..session import stage
from .packed import said_in
from .scaling import (interval_overlap, keys_equal, block_of, fold_rows, nearest, neighbours, point_in_interval,
                      running, runs, spaced, spread_interval, top_n)

EPISODE = ["episode_id"]
HOUR_MS = 3_600_000
BUCKET_MS = 30_000
FRAME_BLOCK = 4_096
#: Buckets of words for each shuffle partition: a bucket is in memory at once.
WORD_BUCKETS = 16


def to_ms(seconds) -> Column:
    return F.round(as_col(seconds) * 1000).cast("bigint")


@dataclass(frozen=True)
class WindowParams:
    """Candidate window settings. The field defaults are the run-time ones; ``of``
    applies the floors that keep a configuration meaningful."""

    target_ms: int = 20_000
    min_ms: int = 10_000
    max_ms: int = 30_000
    stride_ms: int = 15_000
    silence_drift_ms: int = 2_000
    shot_drift_ms: int = 1_000
    min_words: int = 15

    @staticmethod
    def of(**given) -> "WindowParams":
        p = WindowParams(**given)
        low = max(p.min_ms, 5_000)
        high = max(p.max_ms, low + 1_000)
        return WindowParams(min(max(p.target_ms, low), high), low, high,
                            p.stride_ms if p.stride_ms > 0 else 30_000,
                            p.silence_drift_ms, p.shot_drift_ms,
                            p.min_words if p.min_words > 0 else 30)


# -- INT-1, INT-2 -------------------------------------------------------------------

def islands(frames: DataFrame, threshold: float, min_ms: int, frame_ms: int) -> DataFrame:
    """Runs of frames with ``prob`` below ``threshold`` as silences of at least
    ``min_ms``. A run ends where the next frame begins, the last one at the end.

    The quiet frames of a block of the timeline are one sorted array, cut into runs where it is; only runs
    that touch a border of their block, two a block at most, are put together along the episode.
    """
    own = block_of("frame_idx", FRAME_BLOCK)
    quiet = frames.filter(F.col("prob") < threshold).select("episode_id", own.alias("_blk"), "frame_idx")
    blocks = quiet.groupBy("episode_id", "_blk").agg(F.sort_array(F.collect_list("frame_idx")).alias("_f"))
    low, high = F.col("_blk") * FRAME_BLOCK, F.col("_blk") * FRAME_BLOCK + FRAME_BLOCK - 1

    def pieces(of):
        first = F.filter("_f", lambda x, i: (i == 0) | (x - F.get("_f", i - 1) >= 2))
        last = F.filter("_f", lambda x, i: (i == F.size("_f") - 1) | (F.get("_f", i + 1) - x >= 2))
        return of.select("episode_id", "_blk", F.inline(F.zip_with(first, last, lambda a, b: F.struct(a.alias("_a"), b.alias("_z")))))

    def silences(runs):
        return runs.select("episode_id", (F.col("_a") * frame_ms).alias("start_ms"), ((F.col("_z") + 1) * frame_ms).alias("end_ms")).filter(
            F.col("end_ms") - F.col("start_ms") >= min_ms)

    touches = (F.col("_a") == low) | (F.col("_z") == high)
    edges = pieces(blocks.filter((F.element_at("_f", 1) == low) | (F.element_at("_f", -1) == high))).filter(touches)
    along = W.partitionBy("episode_id").orderBy("_a")
    before = F.lag("_z").over(along)
    begins = F.when(before.isNull() | (F.col("_a") - before >= 2), F.col("_a"))
    joined = edges.withColumn("_new", begins).withColumn("_run", F.max("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    whole = joined.groupBy("episode_id", "_run").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"))
    return silences(pieces(blocks).filter(~touches)).unionByName(silences(whole))


def invert_intervals(intervals: DataFrame, totals: DataFrame, min_ms: int) -> DataFrame:
    """Gaps of at least ``min_ms`` left by ``intervals`` in [0, total_ms).

    The furthest end so far is a running maximum over timeline blocks; the tail gap comes
    from one aggregate per episode.
    """
    inside = (intervals.join(totals.filter(F.col("total_ms") > 0), "episode_id")
              .select("episode_id", "total_ms",
                      F.least(F.greatest("start_ms", F.lit(0)), "total_ms").alias("s"),
                      F.least(F.greatest("end_ms", F.lit(0)), "total_ms").alias("e")))
    scanned = running(inside, EPISODE, ["s", "e"], block_of("s", HOUR_MS),
                      cursor=("max", F.col("e")))
    between = scanned.select(
        "episode_id", F.coalesce("cursor", F.lit(0)).cast("bigint").alias("start_ms"),
        F.col("s").alias("end_ms"))
    last = inside.groupBy("episode_id").agg(F.max("e").alias("_last"))
    tail = (totals.filter(F.col("total_ms") > 0).join(last, "episode_id", "left")
            .select("episode_id", F.coalesce("_last", F.lit(0)).cast("bigint")
                    .alias("start_ms"), F.col("total_ms").alias("end_ms")))
    length = F.col("end_ms") - F.col("start_ms")
    return between.unionByName(tail).filter((length > 0) & (length >= min_ms))


# -- INT-3..7: candidate windows ------------------------------------------------------

def snap(points: DataFrame, boundaries: DataFrame, drift_ms: int,
         point_keys: list[str]) -> DataFrame:
    """Move ``t_ms`` of each point to the nearest boundary within ``drift_ms``.

    ``boundaries`` has (episode_id, b_ms, ord); among equally near ones the greatest
    ``ord`` wins. Adds ``snapped_ms`` (the point itself when nothing is near enough).
    """
    marks = boundaries.select("episode_id", F.col("b_ms").alias("_m"), F.lit("b").alias("_kind"), F.col("ord").alias("_ord"))
    near = neighbours(points.select("episode_id", *point_keys, "t_ms"), marks, EPISODE, "t_ms", drift_ms, BUCKET_MS, ["b"])
    return near.select("episode_id", *point_keys, "t_ms", F.coalesce(nearest(F.col("t_ms"), "b", drift_ms), "t_ms").alias("snapped_ms"))


def silence_boundaries(silences: DataFrame) -> DataFrame:
    """Both ends of each silence, in (start, then end) order."""
    return silences.select(
        "episode_id", F.posexplode(F.array("start_ms", "end_ms")).alias("_side", "b_ms"),
        F.col("start_ms").alias("_s")).select(
        "episode_id", "b_ms", F.struct(F.col("_s"), F.col("_side")).alias("ord"))


def grid(episodes: DataFrame, p: WindowParams) -> DataFrame:
    """Proposed windows [i*stride, +target) clipped to the recording, while a minimum
    length fits."""
    fits = episodes.filter(F.col("total_ms") >= p.min_ms)
    last = F.floor((F.col("total_ms") - p.min_ms) / p.stride_ms)
    return (fits.select("episode_id", "total_ms",
                        F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("window_id"))
            .withColumn("start_ms", F.col("window_id") * p.stride_ms)
            .withColumn("end_ms", F.least(F.col("start_ms") + p.target_ms, "total_ms")))


def clamp_window(start: Column, end: Column, total: Column, p: WindowParams):
    """Final (start, end): inside the recording, between min and max long."""
    s = F.least(F.greatest(start, F.lit(0)), total)
    e = F.least(F.greatest(end, s), total)
    e = F.least(e, s + p.max_ms, total)
    return s, F.greatest(e, F.least(s + p.min_ms, total))


def window_boundaries(silences: DataFrame, shots: DataFrame) -> DataFrame:
    """(episode_id, b_ms, kind, ord) of both kinds of boundary."""
    cuts = shots.select("episode_id", F.col("t_ms").alias("b_ms"), F.lit("shot").alias("kind"),
                        F.struct(F.col("t_ms").alias("_s"), F.lit(0).alias("_side")).alias("ord"))
    return silence_boundaries(silences).select("episode_id", "b_ms", F.lit("silence").alias("kind"), "ord").unionByName(cuts)


def snap_windows(windows: DataFrame, silences: DataFrame, shots: DataFrame, p: WindowParams) -> DataFrame:
    """Snap both ends to silences, else to shots, then clamp."""
    return snap_to_boundaries(windows, window_boundaries(silences, shots), p)


def snap_to_boundaries(windows: DataFrame, boundaries: DataFrame, p: WindowParams) -> DataFrame:
    """``snap_windows`` for boundaries of both kinds in one table, as of ``window_boundaries``.

    Both ends pass once beside both kinds of boundary. An end that already lies on a
    silence boundary counts as not moved and is still offered to the shots.
    """
    marks = boundaries.select("episode_id", F.col("b_ms").alias("_m"), F.col("kind").alias("_kind"), F.col("ord").alias("_ord"))
    ends = windows.select("episode_id", "window_id", "total_ms", "start_ms", "end_ms", F.inline(F.array(
        F.struct(F.lit("s").alias("side"), F.col("start_ms").alias("at")),
        F.struct(F.lit("e").alias("side"), F.col("end_ms").alias("at")))))
    near = neighbours(ends, marks, EPISODE, "at", max(p.silence_drift_ms, p.shot_drift_ms), BUCKET_MS, ["silence", "shot"])
    at = F.col("at")
    by_silence = F.coalesce(nearest(at, "silence", p.silence_drift_ms), at)
    settled = F.when(by_silence == at, F.coalesce(nearest(at, "shot", p.shot_drift_ms), at)).otherwise(by_silence)
    found = near.withColumn("_to", settled).groupBy("episode_id", "window_id", "total_ms", "start_ms", "end_ms").agg(
        F.max(F.when(F.col("side") == "s", F.col("_to"))).alias("_s"), F.max(F.when(F.col("side") == "e", F.col("_to"))).alias("_e"))
    s, e = clamp_window(F.col("_s"), F.col("_e"), F.col("total_ms"), p)
    return found.select("episode_id", "window_id", "total_ms",
                        F.col("start_ms").alias("grid_start_ms"),
                        F.col("end_ms").alias("grid_end_ms"),
                        s.alias("start_ms"), e.alias("end_ms"))


def _word_blocks(words: DataFrame, row: Column, width: int) -> DataFrame:
    """(episode_id, _wb, _ws): the sorted words (``row``, which begins with their start) of each block of
    the timeline as one array. Words that lie together meet before they move."""
    return words.groupBy("episode_id", block_of("start_ms", width).alias("_wb")).agg(F.sort_array(F.collect_list(row)).alias("_ws"))


def _beside_words(windows: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """``windows`` once per block they touch, beside the words of that block, if any."""
    left = windows.withColumn("_blk", spread_interval("start_ms", "end_ms", width))
    right, cond, drop = keys_equal(blocks, EPISODE)
    return left.join(right, cond & (F.col("_blk") == F.col("_wb")), "left").drop(*drop, "_wb")


def _starts_inside(word_start: Column) -> Column:
    return (word_start >= F.col("start_ms")) & (word_start < F.col("end_ms"))


def count_words(windows: DataFrame, words: DataFrame, width: int = BUCKET_MS) -> DataFrame:
    """Adds word_count, without the words themselves."""
    # Where a word starts in its block takes two bytes, if the block is no wider.
    begins = F.col("start_ms") - block_of("start_ms", width) * width
    if width <= 1 << 15 and words.schema["start_ms"].dataType.typeName() in ("long", "integer"):
        begins = begins.cast("smallint")
    beside = _beside_words(windows, _word_blocks(words, begins, width), width).withColumn("_from", F.col("_blk") * width)
    inside = F.coalesce(F.size(F.filter("_ws", lambda w: _starts_inside(w + F.col("_from")))), F.lit(0))
    return (beside.select(*windows.columns, F.greatest(inside, F.lit(0)).cast("bigint").alias("_n"))
            .groupBy(*windows.columns).agg(F.sum("_n").alias("word_count")))


def window_words(windows: DataFrame, words: DataFrame, width: int = BUCKET_MS,
                 joiner: str = " ") -> DataFrame:
    """Adds transcript, word_count and speaking_rate (words per second, NULL for an empty
    window) from the words that start inside each window.

    The words of a block are joined to the windows as one array; what a window takes of it moves
    on as one text, and texts of later blocks follow those of earlier ones. ``packed_window_words``
    gives the same rows and moves less.
    """
    blocks = _word_blocks(words, F.struct(F.col("start_ms").alias("_w"), "pos", "text"), width)
    beside = _beside_words(windows, blocks, width)
    said = F.filter("_ws", lambda w: _starts_inside(w["_w"]))
    found = beside.select(*windows.columns, "_blk", F.inline_outer(F.array(F.struct(
        F.greatest(F.coalesce(F.size(said), F.lit(0)), F.lit(0)).cast("bigint").alias("_n"),
        F.filter(F.transform(said, lambda w: w["text"]), lambda x: x.isNotNull()).alias("_t")))))
    # A block without words says nothing, but a window without any has its first one.
    found = found.filter((F.col("_n") > 0) | (F.col("_blk") == block_of("start_ms", width)))
    text = F.when(F.size("_t") > 0, F.array_join("_t", joiner))
    return _whole_texts(found.select(*windows.columns, "_blk", "_n", text.alias("_t")), windows.columns, joiner)


def packed_window_words(windows: DataFrame, words: DataFrame, width: int = BUCKET_MS, joiner: str = " ") -> DataFrame:
    """``window_words`` for many words: those of a block meet the windows that touch it as compressed
    batches (``said_in``), not as arrays of rows."""
    buckets = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * WORD_BUCKETS
    found = said_in(windows.withColumn("_blk", spread_interval("start_ms", "end_ms", width)), words.withColumn("_blk", block_of("start_ms", width)), joiner, buckets)
    found = found.filter((F.col("_n") > 0) | (F.col("_blk") == block_of("start_ms", width)))
    return _whole_texts(found, windows.columns, joiner)


def _whole_texts(pieces: DataFrame, names: list[str], joiner: str) -> DataFrame:
    """Windows (``names``) with what they take of each block (_blk, _n words, text _t) put together."""
    piece = F.when(F.col("_t").isNotNull(), F.struct("_blk", F.col("_t").alias("t")))
    length = F.col("end_ms") - F.col("start_ms")
    return (pieces.select(*names, "_n", piece.alias("_piece")).groupBy(*names)
            .agg(F.sort_array(F.collect_list("_piece")).alias("_said"), F.sum("_n").alias("word_count"))
            .withColumn("transcript", F.array_join(F.transform("_said", lambda p: p["t"]), joiner))
            .withColumn("speaking_rate", F.when(length > 0, F.col("word_count") * 1000 / length))
            .drop("_said").select(*names, "word_count", "transcript", "speaking_rate"))


def dedupe_windows(windows: DataFrame, p: WindowParams, eps_ms: int = 500) -> DataFrame:
    """Drop short or wordless windows, then near-copies of the last window kept.

    A window that starts ``eps_ms`` or more after every earlier one is certainly kept; the
    timeline is cut there. The bounds of a stretch between two cuts are one array, folded in
    the JVM; most hold one window. ``windows`` is read three times: ``stage`` it when it is
    expensive, and let the texts join the windows that are left (``count_words``, ``window_words``).
    """
    good = windows.filter((F.col("end_ms") - F.col("start_ms") >= p.min_ms)
                          & (F.col("word_count") >= p.min_words))
    bounds = good.select("episode_id", "window_id", "start_ms", "end_ms")
    cut = runs(bounds, EPISODE, "window_id", "start_ms", eps_ms, FRAME_BLOCK)
    row = F.struct("window_id", "start_ms", "end_ms")
    kept = (cut.groupBy("episode_id", "run_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
            .select("episode_id", F.explode(_apart(F.col("_rows"), eps_ms)).alias("window_id")))
    return good.join(kept, ["episode_id", "window_id"], "left_semi").select(*windows.columns)


def _apart(rows: Column, eps_ms: int) -> Column:
    """window_id of the rows (window_id, start_ms, end_ms) that differ by ``eps_ms`` at one end from
    the last one kept."""
    def step(last, row):
        near = (F.abs(row["start_ms"] - last["start_ms"]) < eps_ms) & (F.abs(row["end_ms"] - last["end_ms"]) < eps_ms)
        return F.when(F.coalesce(near, F.lit(False)), F.struct(last.alias("state"), F.array().cast("array<bigint>").alias("out"))).otherwise(
            F.struct(row.alias("state"), F.array(row["window_id"]).alias("out")))

    return fold_rows(rows, F.lit(None).cast("struct<window_id:bigint,start_ms:bigint,end_ms:bigint>"), "bigint", step)


# -- INT-8..11 ----------------------------------------------------------------------

def drop_contained(words: DataFrame, silences: DataFrame) -> DataFrame:
    """Words not wholly inside one silence; words across an edge stay."""
    spread = silences.select("episode_id", F.col("start_ms").alias("_s"),
                             F.col("end_ms").alias("_e")).withColumn(
        "_blk", F.explode(F.sequence(block_of("_s", BUCKET_MS), block_of("_e", BUCKET_MS))))
    left = words.withColumn("_blk", block_of("start_ms", BUCKET_MS))
    right, cond, _ = keys_equal(spread, ["episode_id", "_blk"])
    cond = cond & (F.col("start_ms") >= F.col("_s")) & (F.col("end_ms") <= F.col("_e"))
    return left.join(right, cond, "left_anti").drop("_blk")


def dedupe_by_gap(df: DataFrame, keys: list[str], t: str, eps_ms: int) -> DataFrame:
    """Distinct times per key, each at least ``eps_ms`` after the last one kept.

    Equal times are merged before the shuffle; ``spaced`` finds the rest without a walk.
    """
    return spaced(df.select(*keys, t).distinct(), keys, t, eps_ms, HOUR_MS)


def overlap_ms(windows: DataFrame, speech: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, overlap_ms): summed overlap of each window with the speech segments."""
    right = speech.select("episode_id", F.col("start_ms").alias("_s"),
                          F.col("end_ms").alias("_e"))
    pairs = interval_overlap(windows, right, EPISODE, "start_ms", "end_ms", "_s", "_e",
                             BUCKET_MS)
    total = pairs.groupBy("episode_id", *keys).agg(F.sum(
        F.least("end_ms", "_e") - F.greatest("start_ms", "_s")).alias("_ov"))
    return (windows.join(total, ["episode_id", *keys], "left")
            .withColumn("overlap_ms", F.coalesce("_ov", F.lit(0)).cast("bigint")).drop("_ov"))


def in_any(points: DataFrame, intervals: DataFrame, how: str = "left_semi") -> DataFrame:
    """Points whose ``t_ms`` lies in some [start_ms, end_ms)."""
    spread = intervals.select("episode_id", F.col("start_ms").alias("_s"),
                              F.col("end_ms").alias("_e")).withColumn(
        "_blk", spread_interval("_s", "_e", BUCKET_MS))
    right, cond, _ = keys_equal(spread, ["episode_id", "_blk"])
    cond = cond & (F.col("t_ms") >= F.col("_s")) & (F.col("t_ms") < F.col("_e"))
    return points.withColumn("_blk", block_of("t_ms", BUCKET_MS)).join(right, cond, how).drop("_blk")


# -- INT-12..16: chunks and clips -----------------------------------------------------

def stitch_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, segments) of chunk-local arrays on the episode timeline.

    ``chunks``: episode_id, chunk_idx, offset_ms, words array<struct(word,start,end)>,
    segments array<struct(start,end,text)>, times in seconds. The order key is
    (chunk_idx, pos); blank segments are dropped.
    """
    def at(col):
        return F.greatest(to_ms(col) + F.col("offset_ms"), F.lit(0)).cast("bigint")

    words = (chunks.select("episode_id", "chunk_idx", "offset_ms",
                           F.posexplode("words").alias("pos", "w"))
             .select("episode_id", "chunk_idx", F.col("pos").cast("bigint").alias("pos"),
                     F.col("w.word").alias("text"), at("w.start").alias("start_ms"),
                     at("w.end").alias("end_ms")))
    segments = (chunks.select("episode_id", "chunk_idx", "offset_ms",
                              F.posexplode("segments").alias("pos", "s"))
                .select("episode_id", "chunk_idx", F.col("pos").cast("bigint").alias("pos"),
                        (to_ms("s.start") + F.col("offset_ms")).alias("start_ms"),
                        (to_ms("s.end") + F.col("offset_ms")).alias("end_ms"),
                        F.col("s.text").alias("text"))
                .filter(trim_ws("text") != ""))
    return words, segments


def plan_chunks(episodes: DataFrame, target_chunks: int, min_secs: int, max_secs: int
                ) -> DataFrame:
    """Chunk offsets and lengths: about ``target_chunks`` per episode, chunk length in
    whole seconds within [min, max], the last chunk clipped."""
    secs = F.ceil(F.col("total_ms") / (1000 * target_chunks))
    size = F.least(F.greatest(secs, F.lit(min_secs)), F.lit(max_secs)).cast("bigint") * 1000
    n = F.ceil(F.col("total_ms") / size).cast("bigint")
    return (episodes.filter(F.col("total_ms") > 0).withColumn("_size", size)
            .select("episode_id", "total_ms", "_size",
                    F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk_idx"))
            .select("episode_id", "chunk_idx",
                    (F.col("chunk_idx") * F.col("_size")).alias("offset_ms"),
                    F.least("_size", F.col("total_ms") - F.col("chunk_idx") * F.col("_size"))
                    .alias("duration_ms")))


def clip_words(clips: DataFrame, words: DataFrame, slack_ms: int = 500) -> DataFrame:
    """Words inside each clip (start at or after its start, end within ``slack_ms`` of its
    end), re-based to the clip."""
    spans = clips.select("episode_id", "clip_id", F.col("start_ms").alias("_cs"),
                         (F.col("end_ms") + slack_ms + 1).alias("_ce"))
    right = words.select("episode_id", "pos", "text", F.col("start_ms").alias("_ws"),
                         F.col("end_ms").alias("_we"))
    inside = point_in_interval(spans, right, EPISODE, "_cs", "_ce", "_ws", BUCKET_MS)
    return (inside.filter(F.col("_we") < F.col("_ce")).select(
        "episode_id", "clip_id", "pos", "text",
        F.greatest(F.col("_ws") - F.col("_cs"), F.lit(0)).alias("start_ms"),
        F.greatest(F.col("_we") - F.col("_cs"), F.lit(0)).alias("end_ms")))


RECUT_MIN_MS, RECUT_MAX_MS = 3_000, 300_000   # fixed values: allowed clip length


def check_recuts(edits: DataFrame) -> DataFrame:
    """Edits (new_start_s, new_end_s) with clamped bounds and a rejection reason."""
    a, b = F.col("new_start_s"), F.col("new_end_s")
    inf = F.lit(float("inf"))
    finite = (a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
              & (F.abs(a) != inf) & (F.abs(b) != inf))
    start = to_ms(F.when(finite, F.greatest(a, F.lit(0.0))))
    end = to_ms(F.when(finite, b))
    length = end - start
    return edits.withColumn("new_start_ms", start).withColumn("new_end_ms", end).withColumn(
        "reason", F.when(~finite, "start/end must be finite")
        .when(length < RECUT_MIN_MS, F.concat(
            F.lit("duration "), fixed(length / 1000, 1), F.lit("s below 3s minimum")))
        .when(length > RECUT_MAX_MS, F.concat(
            F.lit("duration "), fixed(length / 1000, 1),
            F.lit("s above 300s maximum"))))


def recut(clips: DataFrame, edits: DataFrame, clip_word_rows: DataFrame
          ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new bounds, re-anchored words, rejected edits) for clip re-trims.

    ``clip_word_rows`` are relative to the old clip start, one clip's words being bounded
    by its length. The checked edits, which all three read, are written once; a small file may be many rows, so it is never broadcast.
    """
    checked = stage(check_recuts(clips.join(edits.hint("merge"), "clip_id")), "recuts")
    rejected = checked.filter(F.col("reason").isNotNull()).select("clip_id", "reason")
    ok = checked.filter(F.col("reason").isNull())
    off = F.greatest(F.col("new_start_ms") - F.col("start_ms"), F.lit(0))
    bounds = ok.select("episode_id", "clip_id", F.col("new_start_ms").alias("start_ms"),
                       F.col("new_end_ms").alias("end_ms"))
    spans = ok.select("clip_id", off.alias("_off"),
                      (F.col("new_end_ms") - F.col("new_start_ms")).alias("_len"))
    words = (clip_word_rows.join(spans.hint("merge"), "clip_id")
             .filter((F.col("start_ms") >= F.col("_off") - 1)
                     & (F.col("end_ms") <= F.col("_off") + F.col("_len") + 500))
             .withColumn("start_ms", F.greatest(F.col("start_ms") - F.col("_off"), F.lit(0)))
             .withColumn("end_ms", F.greatest(F.col("end_ms") - F.col("_off"), F.lit(0)))
             .drop("_off", "_len"))
    return bounds, words, rejected


def synth_segments(chunks: DataFrame) -> DataFrame:
    """One segment per minute for chunk texts that came without segments."""
    dur = F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(60_000)
    base = chunks.select("episode_id", "chunk_idx", "offset_ms", "text",
                         dur.cast("bigint").alias("_dur"), tokens("text").alias("_toks"))
    base = base.withColumn("_n", F.size("_toks").cast("bigint")).withColumn(
        "_m", F.when(F.col("_n") == 0, F.lit(1)).otherwise(
            F.greatest(F.ceil(F.col("_dur") / 60_000), F.lit(1))).cast("bigint"))
    rows = base.withColumn("minute", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)))
    a = F.floor(F.col("minute") * F.col("_n") / F.col("_m"))
    b = F.least(F.greatest(F.floor((F.col("minute") + 1) * F.col("_n") / F.col("_m")), a + 1),
                F.col("_n"))
    said = F.array_join(F.slice("_toks", (a + 1).cast("int"),
                                F.greatest(b - a, F.lit(0)).cast("int")), " ")
    start = F.col("offset_ms") + F.col("minute") * 60_000
    full = F.col("offset_ms") + F.col("_dur")
    return rows.select(
        "episode_id", "chunk_idx", "minute",
        F.when(F.col("_n") == 0, F.col("offset_ms")).otherwise(start).alias("start_ms"),
        F.when(F.col("_n") == 0, full).otherwise(F.least(start + 60_000, full)).alias("end_ms"),
        F.when(F.col("_n") == 0, F.col("text")).otherwise(said).alias("text"))


# -- INT-17..19 ---------------------------------------------------------------------

def minute_index(segments: DataFrame, max_minutes: int = 180, max_bytes: int = 800,
                 max_chars: int = 600) -> DataFrame:
    """(episode_id, minute, text): the opening text of each of the first minutes.

    Every appended segment adds at least one byte, so no more than ``max_bytes`` segments
    of a minute can count; that exact bound is applied before the shuffle. Texts move once, to their
    minute: which minutes are an episode's first is found from their numbers alone.
    """
    pieces = segments.select(
        "episode_id", F.floor(F.greatest("start_ms", F.lit(0)) / 60_000).alias("minute"),
        "ord", F.concat(trim_ws("text"), F.lit(" ")).alias("_piece"))
    first = top_n(pieces, ["episode_id", "minute"], ["ord"], max_bytes)
    upto = (W.partitionBy("episode_id", "minute").orderBy("ord")
            .rowsBetween(W.unboundedPreceding, -1))
    before = F.coalesce(F.sum(F.octet_length("_piece")).over(upto), F.lit(0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_piece"))),
                                    lambda r: r["_piece"]), "")
    minutes = (first.withColumn("_before", before).filter(F.col("_before") < max_bytes)
               .groupBy("episode_id", "minute").agg(text.alias("_text"))
               .select("episode_id", "minute", clamp_chars("_text", max_chars).alias("text")))
    firsts = top_n(pieces.select("episode_id", "minute").distinct(), EPISODE, ["minute"], max_minutes)
    # The merge join keeps the minutes where they are.
    return minutes.join(firsts.hint("merge"), ["episode_id", "minute"], "left_semi")


def sample_times(clips: DataFrame, fps: float | None = None, n: int | None = None,
                 mode: str = "mid") -> DataFrame:
    """Evenly spaced sample times of each clip.

    ``mode='mid'``: midpoints of n equal parts, n from ``fps`` unless given.
    ``mode='interior'``: n points that divide the clip into n+1 parts.
    """
    d = (F.col("end_ms") - F.col("start_ms")).cast("double")
    count = (F.lit(n).cast("bigint") if n is not None
             else F.greatest(F.round(d / 1000 * fps), F.lit(1.0)).cast("bigint"))
    base = clips.filter(d > 0).withColumn("_n", count)
    rows = base.withColumn("sample_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    i, m = F.col("sample_idx"), F.col("_n")
    part = (i + 0.5) * d / m if mode == "mid" else (i + 1) * d / (m + 1)
    return rows.withColumn("t_ms", F.col("start_ms") + part).drop("_n")


FILLER = "big reaction — safe filler"   # fixed values: texts of repaired moments
UNNAMED = "thumbnail moment"


def repair_moments(moments: DataFrame, segments: DataFrame, n: int) -> DataFrame:
    """Exactly the usable moments of each episode, padded towards ``n``.

    Bad times become 0, blank reasons get a default. Short lists are padded at position
    ``len + 2*i`` (the list grows while it is padded) times ``last/(n-1)``; then near-copies
    (under 250 ms) are dropped and the first ``n`` kept. ``episodes`` are those of
    ``segments``.
    """
    t = F.col("center_s")
    bad = t.isNull() | F.isnan(t) | (F.abs(t) == float("inf")) | (t < 0)
    fixed = moments.select(
        "episode_id", F.col("pos").cast("bigint").alias("pos"),
        to_ms(F.when(bad, 0.0).otherwise(t)).alias("t_ms"),
        F.when(trim_ws(F.coalesce("reason", F.lit(""))) == "", UNNAMED)
        .otherwise(F.col("reason")).alias("reason"))
    extent = segments.groupBy("episode_id").agg(
        F.max(F.greatest("start_ms", "end_ms", F.lit(0))).alias("_end"))
    have = fixed.groupBy("episode_id").agg(F.count("*").alias("_have"))
    last = F.greatest(F.col("_end") - 250, F.lit(0))
    step = last / (n - 1) if n > 1 else F.lit(0.0)
    short = (extent.join(have, "episode_id", "left")
             .withColumn("_have", F.coalesce("_have", F.lit(0)))
             .filter(F.col("_have") < n).withColumn("_last", last))
    pads = short.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                       F.lit(n) - F.col("_have") - 1)))
    pads = pads.select(
        "episode_id", (F.col("_have") + F.col("_i")).alias("pos"),
        F.least((F.col("_have") + 2 * F.col("_i")) * step, F.col("_last")).cast("bigint").alias("t_ms"),
        F.lit(FILLER).alias("reason"))
    every = fixed.unionByName(pads)
    kept = dedupe_by_gap(every, EPISODE, "t_ms", 250)
    named = every.groupBy("episode_id", "t_ms").agg(F.min_by("reason", "pos").alias("reason"))
    return top_n(kept.join(named, ["episode_id", "t_ms"]), EPISODE, ["t_ms"], n, rank="slot")
