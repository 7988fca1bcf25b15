"""Trend snapshots: latest, fresh, merged, panel (TR-1..5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scaling import top_n

FRESH_S = 24 * 3600     # fixed value
# Panel sources, their scale, rows read and rows shown per source.
PANEL = {"gdelt": 1.0, "reddit": 1_000.0, "google": 1_000_000.0}
PANEL_ROWS, PANEL_PER_SOURCE = 300, 15
SOURCES = ["gdelt", "reddit", "google"]


def latest_per_topic(trends: DataFrame) -> DataFrame:
    """Newest row of each (source, topic), by one map-side combined aggregate."""
    row = F.max_by(F.struct("label", "score"), "fetched_at")
    return (trends.groupBy("source", "topic_id").agg(row.alias("_r"), F.max("fetched_at").alias("fetched_at"))
            .select("source", "topic_id", "_r.label", "_r.score", "fetched_at"))


def recent_trends(trends: DataFrame, n: int) -> DataFrame:
    """Top ``n`` of the newest rows by score; none for n = 0."""
    return latest_per_topic(trends).orderBy(F.desc("score"), "source", "topic_id").limit(n)


def latest_batch(trends: DataFrame) -> DataFrame:
    """All rows of each source's newest fetch."""
    newest = trends.groupBy("source").agg(F.max("fetched_at").alias("fetched_at"))
    return trends.join(newest, ["source", "fetched_at"], "left_semi")


def source_freshness(trends: DataFrame, as_of: int, sources: list[str]) -> DataFrame:
    """Age and freshness of every asked source; a source without rows counts as fetched
    at 0."""
    last = trends.groupBy("source").agg(F.max("fetched_at").alias("_m"))
    asked = trends.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    age = F.lit(as_of) - F.coalesce("_m", F.lit(0))
    return asked.join(last, "source", "left").select(
        "source", F.coalesce("_m", F.lit(0)).alias("last_fetched"), age.alias("age_s"),
        (age < FRESH_S).alias("fresh"))


def current_trends(trends: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Newest batches of the sources merged, best score first."""
    keep = latest_batch(trends.filter(F.col("source").isin(sources or SOURCES)))
    return keep.select("source", "topic_id", "label", "score").orderBy(F.desc("score"), "source", "topic_id")


def trend_panel(trends: DataFrame, as_of: int, scales: dict[str, float] | None = None) -> DataFrame:
    """The last day's newest rows, cut to 300 overall and then 15 per source, with scaled
    values."""
    scales = scales or PANEL
    seen = (trends.filter(F.col("fetched_at") >= as_of - FRESH_S)
            .orderBy(F.desc("fetched_at"), F.desc("score"), "source", "topic_id").limit(PANEL_ROWS)
            .filter(F.col("source").isin(list(scales))))
    shown = top_n(seen, ["source"], [F.desc("fetched_at"), F.desc("score"), "topic_id"], PANEL_PER_SOURCE, rank="pos")
    scale = F.try_element_at(F.create_map(*[F.lit(x) for kv in scales.items() for x in kv]), F.col("source"))
    score = F.coalesce("score", F.lit(0.0))
    return shown.select("source", "pos", F.coalesce("label", "topic_id").alias("topic"),
                        F.when(scale == 1.0, score).otherwise(F.round(score * scale)).alias("value"))
