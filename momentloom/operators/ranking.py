"""Rank batches, top-K, blended re-scoring and final clips (RK-1..7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import blend, clamp_score, fixed, trim_ws
from ..sources.feeds import clamp_refined  # noqa: F401  (RK-2)
from .intervals import EPISODE, FRAME_BLOCK
from .scaling import block_of, running, top_n

BATCH = 10   # fixed value: candidates per ranking request


# -- RK-1 ---------------------------------------------------------------------------

def index_candidates(candidates: DataFrame, size: int = BATCH) -> DataFrame:
    """Adds candidate_index (0-based, in window order), batch_idx and index in the batch."""
    out = running(candidates, EPISODE, ["window_id"], block_of("window_id", FRAME_BLOCK),
                  candidate_index=("count", F.lit(1)))
    return (out.withColumn("batch_idx", F.floor(F.col("candidate_index") / size))
            .withColumn("index", F.col("candidate_index") % size))


def rank_batches(candidates: DataFrame, size: int = BATCH) -> DataFrame:
    """(episode_id, batch_idx, n, payload): JSON of at most ``size`` candidates each.

    Missing signals are written as null, but missing audio events are left out.
    """
    c = index_candidates(candidates, size)
    fields = [
        F.col("index"), F.col("candidate_index").alias("episode_index"),
        (F.col("start_ms") / 1000).alias("start_secs"), (F.col("end_ms") / 1000).alias("end_secs"), F.col("transcript"),
        F.struct(*[F.col(f"linguistic.{n}").alias(n) for n in (
            "conflict_markers", "strong_claim", "confessional", "topic_shift", "questions", "numbers",
            "short_declaratives", "quotable_lines")]).alias("linguistic"),
        F.struct("rms_peak_db", "rms_mean_db", "f0_mean_hz", "f0_variance_hz2", "f0_peak_hz",
                 F.col("speaking_rate").alias("speaking_rate_wps")).alias("prosody"),
        F.col("novelty")]
    keep_nulls = {"ignoreNullFields": "false"}
    one = (F.when(F.col("audio_events").isNull(), F.to_json(F.struct(*fields), keep_nulls))
           .otherwise(F.to_json(F.struct(*fields, "audio_events"), keep_nulls)))
    lines = F.array_sort(F.collect_list(F.struct("index", one.alias("json"))))
    return (c.groupBy("episode_id", "batch_idx").agg(lines.alias("_l"), F.count("*").alias("n"))
            .select("episode_id", "batch_idx", "n", F.concat(
                F.lit("["), F.array_join(F.transform("_l", lambda r: r["json"]), ","), F.lit("]")).alias("payload")))


# -- RK-3 ---------------------------------------------------------------------------

def top_k(ranked: DataFrame, k: int, rerank_k: int | None = None) -> DataFrame:
    """The best ``max(k, rerank_k)`` rows per episode as position ``ord`` 1, 2, ...; equal
    scores stay in answer order. Each task ships at most that many rows per episode."""
    wide = max(max(k, 1), rerank_k or 0)
    return top_n(ranked, EPISODE, [F.desc("score"), "batch_idx", "pos"], wide, rank="ord")


# -- RK-4, RK-5 ---------------------------------------------------------------------

# Weight of the second score, rows re-scored, label in the reason.
LANES = {"vlm": (0.5, 20, "vlm"), "vlm_premium": (0.6, 3, "premium_vlm")}


def blend_lane(ranked: DataFrame, scores: DataFrame, lane: str = "vlm", weight: float | None = None,
               n: int | None = None) -> DataFrame:
    """Blend a second score into the first ``n`` rows of each episode and re-order.

    ``ranked`` comes from ``top_k`` (a bounded number of rows per episode), ``scores`` has
    (episode_id, candidate_index, second, why). Rows without a second score keep theirs;
    re-ordering is stable. A second lane works on the already blended score.
    """
    w, first, label = LANES[lane]
    w, first = weight if weight is not None else w, n if n is not None else first
    second = scores.select("episode_id", "candidate_index", F.col("second").alias("_s"),
                           F.coalesce("why", F.lit("")).alias("_why"))
    # Scores of all candidates grow with the input; see ``read_rank_responses``.
    near = ranked.join(second.hint("merge"), ["episode_id", "candidate_index"], "left")
    hit = (F.col("ord") <= first) & F.col("_s").isNotNull()
    out = near.select(
        *[c for c in ranked.columns if c not in ("score", "reasoning", "ord")], F.col("ord").alias("_before"),
        F.when(hit, blend("score", "_s", w)).otherwise(F.col("score")).alias("score"),
        F.when(hit & (F.col("_why") != ""), F.concat("reasoning", F.lit(f" | {label}: "), "_why"))
        .otherwise(F.col("reasoning")).alias("reasoning"),
        F.when(hit, clamp_score("_s")).cast("bigint").alias(f"{lane}_score"),
        F.when(hit & (F.col("_why") != ""), F.col("_why")).alias(f"{lane}_reasoning"))
    order = W.partitionBy("episode_id").orderBy(F.desc("score"), "_before")
    return out.withColumn("ord", F.row_number().over(order)).drop("_before")


# -- RK-6, RK-7 ---------------------------------------------------------------------

def finalize_clips(ranked: DataFrame, k: int) -> DataFrame:
    """Clip rows of the first ``k`` positions: id, rank and status ``generated``."""
    kept = ranked.filter(F.col("ord") <= max(k, 1))
    return kept.select(
        F.concat(F.col("episode_id").cast("string"), F.lit("_clip_"), "ord").alias("id"),
        F.col("episode_id").alias("job_id"), F.col("start_ms").cast("bigint").alias("start_ms"),
        F.col("end_ms").cast("bigint").alias("end_ms"), F.col("ord").cast("bigint").alias("rank"),
        F.col("score").cast("double").alias("score"), "hook", "reasoning", "trend_match", "hook_type",
        F.lit("generated").alias("status"))


def trends_text(trends: DataFrame) -> DataFrame:
    """One row: the trend lines, best first and those without a score last (at most the N of ``recent_trends``)."""
    line = F.concat(F.lit("- "), F.coalesce("label", "topic_id"),
                    F.coalesce(F.concat(F.lit(" (score: "), fixed("score", 0), F.lit(")")), F.lit("")),
                    F.lit(" ["), "source", F.lit("]"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("s"), "source", "topic_id", line.alias("line"))))
    return trends.agg(ordered.alias("_l")).select(F.array_join(
        F.transform("_l", lambda r: r["line"]), "\n").alias("trends_text"))


def prompt_context(episodes: DataFrame, trends: DataFrame, priors: DataFrame, history: DataFrame) -> DataFrame:
    """(episode_id, current_trends, performance_history) for every episode.

    ``episodes``: episode_id, show_slug; ``trends``: the bounded recent trends; ``priors``:
    show_slug, content (one file per show); ``history``: one row with column history. The
    one-row texts enter as scalar subqueries.
    """
    top = F.coalesce(trends_text(trends).scalar(), F.lit(""))
    lines = F.filter(F.transform(F.split("content", "\n"), trim_ws), lambda x: x != "")
    own = priors.select("show_slug", F.when(F.size(lines) > 0, F.concat(
        F.lit("Show topic priors:\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))).alias("_own"))
    both = episodes.join(own, "show_slug", "left").withColumn("_top", top)
    text = (F.when((F.col("_top") != "") & F.col("_own").isNotNull(), F.concat("_top", F.lit("\n\n"), "_own"))
            .when(F.col("_own").isNotNull(), F.concat(F.lit("\n"), "_own"))
            .when(F.col("_top") != "", F.col("_top")))
    return both.select("episode_id", F.when(text.isNotNull(), F.concat(
        F.lit("CURRENT TRENDS (boost candidates that align with these topics):\n"), text)).otherwise("").alias("current_trends"),
        F.coalesce(history.scalar(), F.lit("")).alias("performance_history"))
