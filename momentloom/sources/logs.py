"""Text logs to tables (SRC-2..5, SRC-9).

``lines`` has the episode key, an order key ``ord`` that grows through one log, an
integer ``part`` that never decreases along it, and the text ``line``. A log of any
length is worked on in parts: state that crosses a part border is carried by a
row-per-part table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_ws
from ..operators.intervals import EPISODE, dedupe_by_gap, to_ms
from ..operators.scaling import running

# The notations of the logs.
SILENCE_START = r"silence_start:\s*(-?\d+(?:\.\d+)?)"
SILENCE_END = r"silence_end:\s*(-?\d+(?:\.\d+)?)"
CUT_TIME = r"pts_time:(\d+(?:\.\d+)?)"
FRAME_TIME = r"pts_time:(-?\d+(?:\.\d+)?)"
LEVEL_ALL = r"lavfi\.astats\.Overall\.RMS_level=(-?\d+(?:\.\d+)?|-?inf)"
LEVEL_ONE = r"lavfi\.astats\.\d+\.RMS_level=(-?\d+(?:\.\d+)?|-?inf)"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a directory of logs named ``<episode_id>.<ext>``.

    Files stay splittable: the order key is (offset of the split, row within the read),
    and the split offset is the part.
    """
    lines = spark.read.text(path).select(
        F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("episode_id"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    return lines.select("episode_id", "part", F.struct("part", "_row").alias("ord"), "line")


def _value(pattern: str):
    """The captured number, NULL where the line does not match."""
    return F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).try_cast("double")


def _level(pattern: str):
    raw = F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    return (F.when(raw == "-inf", float("-inf")).when(raw == "inf", float("inf"))
            .otherwise(raw.try_cast("double")))


def read_silence_log(lines: DataFrame) -> DataFrame:
    """Silences: each end line pairs with the line before it among start and end lines,
    when that is a start. Starts are clamped at 0; the end must lie after the start."""
    start, end = _value(SILENCE_START), _value(SILENCE_END)
    marks = lines.withColumn("_s", start).withColumn("_e", F.when(F.col("_s").isNull(), end)).filter(
        F.col("_s").isNotNull() | F.col("_e").isNotNull())
    seen = running(marks, EPISODE, ["ord"], F.col("part").cast("bigint"),
                   _prev=("max", F.struct("ord", F.col("_s").alias("s"))))
    pair = seen.filter(F.col("_e").isNotNull() & F.col("_prev.s").isNotNull())
    return (pair.select("episode_id", to_ms(F.greatest(F.col("_prev.s"), F.lit(0.0))).alias("start_ms"),
                        to_ms("_e").alias("end_ms")).filter(F.col("end_ms") > F.col("start_ms")))


def read_shot_log(lines: DataFrame) -> DataFrame:
    """Cut times, a time within 10 ms of the last one kept dropped. Gaps are measured in
    microseconds, before the times are rounded."""
    found = F.explode(F.regexp_extract_all("line", F.lit(CUT_TIME), F.lit(1)))
    times = lines.select("episode_id", found.alias("_t")).select("episode_id", F.round(
        F.col("_t").try_cast("double") * 1_000_000).cast("bigint").alias("_us")).filter(F.col("_us").isNotNull())
    return dedupe_by_gap(times, EPISODE, "_us", 10_000).select("episode_id", to_ms(F.col("_us") / 1_000_000).alias("t_ms"))


def read_level_log(lines: DataFrame) -> DataFrame:
    """Level curve: a frame runs from one header to the next; its overall level counts,
    else its first channel's. Infinite levels are dropped."""
    header = F.regexp_extract("line", FRAME_TIME, 1) != ""
    tagged = lines.withColumn("_h", header.cast("int"))
    counted = running(tagged, EPISODE, ["ord"], F.col("part").cast("bigint"), _f=("sum", F.col("_h")))
    rows = counted.select(
        "episode_id", (F.coalesce("_f", F.lit(0)) + F.col("_h")).alias("frame"), "ord",
        F.when(F.col("_h") == 1, _value(FRAME_TIME)).alias("_t"),
        F.when(F.col("_h") == 0, _level(LEVEL_ALL)).alias("_all"),
        F.when(F.col("_h") == 0, _level(LEVEL_ONE)).alias("_one"))
    per = rows.groupBy("episode_id", "frame").agg(
        F.max("_t").alias("_t"), F.max_by("_all", F.when(F.col("_all").isNotNull(), F.col("ord"))).alias("_all"),
        F.min_by("_one", F.when(F.col("_one").isNotNull(), F.col("ord"))).alias("_one"))
    db = F.coalesce("_all", "_one")
    return (per.filter(F.col("_t").isNotNull() & db.isNotNull() & (F.abs(db) != float("inf")))
            .select("episode_id", F.greatest(to_ms("_t"), F.lit(0)).cast("bigint").alias("t_ms"),
                    db.alias("rms_db")))


def read_pitch_log(lines: DataFrame) -> DataFrame:
    """``time hertz`` lines; non-finite values dropped, negative pitch becomes 0."""
    parts = F.split(trim_ws("line"), r"(?U)\s+")
    rows = lines.select("episode_id", F.get(parts, F.lit(0)).try_cast("double").alias("_t"),
                        F.get(parts, F.lit(1)).try_cast("double").alias("_p"))

    def finite(c):
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    return rows.filter(finite("_t") & finite("_p")).select(
        "episode_id", to_ms("_t").alias("t_ms"), F.greatest("_p", F.lit(0.0)).alias("pitch_hz"))


def import_seen_ids(lines: DataFrame, jobs: DataFrame, as_of: int) -> DataFrame:
    """New ``done`` jobs for the ids of a list (column ``line``) that are not known yet.
    Count the rows for the number imported."""
    ids = lines.select(trim_ws("line").alias("id")).filter(F.col("id") != "").distinct()
    fresh = ids.join(jobs.select(F.col("id").cast("string").alias("id")), "id", "left_anti")
    return fresh.select("id", F.lit("done").alias("status"), F.lit(as_of).cast("bigint").alias("created_at"),
                        F.lit(as_of).cast("bigint").alias("updated_at"))
