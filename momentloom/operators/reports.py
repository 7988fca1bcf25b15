"""Report tables over jobs, clips, renders, posts, statistics and usage (AN, RPT, FN-13/14).

``as_of`` is always a parameter (unix seconds); nothing reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import fixed, fmt_duration, fmt_iso
from .scaling import numbered

DAY_S = 86_400

# Job status -> (dashboard status, running stage, progress %).
JOB_VIEW = {
    "pending": ("pending", "Queued", 5), "transcribed": ("rendering", "Ranking", 40),
    "ranked": ("rendering", "Rendering clips", 65), "rendered": ("rendering", "Posting", 85),
    "posted": ("rendering", "Finalizing", 95), "done": ("done", "Complete", 100),
    "failed": ("failed", "Failed", 0), "cancelled": ("failed", "Cancelled", 0)}
JOB_VIEW_OTHER = ("pending", "Unknown", 5)

# The stage board and the stage active under each job status.
STAGES = ["ingest", "download", "audio", "transcribe", "features", "rank", "render", "post"]
ACTIVE_STAGE = {"pending": 0, "transcribed": 4, "ranked": 6, "rendered": 7, "posted": 7, "failed": 0}

CHART_PLATFORMS = ["youtube", "bluesky", "linkedin", "threads"]   # fixed values


def _choose(col: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)).otherwise(out)
    return out


# -- FN-13, FN-14 -------------------------------------------------------------------

def job_view(jobs: DataFrame) -> DataFrame:
    """Adds view_status, stage and progress."""
    names = ("view_status", "stage", "progress")
    return jobs.select("*", *[
        _choose(F.col("status"), {k: v[i] for k, v in JOB_VIEW.items()}, JOB_VIEW_OTHER[i]).alias(n)
        for i, n in enumerate(names)])


def stage_board(jobs: DataFrame, latest_only: bool = False) -> DataFrame:
    """Eight rows per job: done / active / idle / error of each stage."""
    if latest_only:
        jobs = jobs.orderBy(F.desc("updated_at"), "id").limit(1)
    rows = jobs.select("*", F.posexplode(F.array(*[F.lit(s) for s in STAGES])).alias("_i", "stage"))
    active = _choose(F.col("status"), ACTIVE_STAGE, None).cast("int")
    bad = (F.col("status") == "failed") | (F.coalesce("error", F.lit("")) != "")
    state = (F.when(F.col("status") == "done", "done").when(bad & (active == F.col("_i")), "error")
             .when(active.isNull(), "idle").when(F.col("_i") < active, "done")
             .when(F.col("_i") == active, "active").otherwise("idle"))
    return rows.withColumn("stage_status", state).withColumnRenamed("_i", "stage_idx")


# -- AN-1 ---------------------------------------------------------------------------

def performance_history(clips: DataFrame, analytics: DataFrame, best: int = 5, worst: int = 3,
                        spare: int = 10, global_worst: bool = False) -> DataFrame:
    """(side, idx, line, ...): best and worst clips by click rate.

    Best and worst come from the first best+worst+spare rows, as a top-N that Spark takes
    per partition first; ``global_worst`` looks for the worst among all rows instead.
    """
    seen = (clips.withColumnRenamed("id", "clip_id")
            .join(analytics.filter(F.col("ctr").isNotNull()).select(
                "clip_id", "platform", "fetched_at", "views", "ctr", "watch_pct"), "clip_id"))
    ties = ["clip_id", "platform", "fetched_at"]
    n = best + worst + spare
    top = seen.orderBy(F.desc("ctr"), *ties).limit(n)
    low = seen.orderBy("ctr", *[F.desc(c) for c in ties]).limit(worst) if global_worst else top
    # At most n rows are left, so a single-partition window is fine.
    one = W.partitionBy(F.lit(1))
    up = top.withColumn("idx", F.row_number().over(one.orderBy(F.desc("ctr"), *ties)))
    down = low.withColumn("idx", F.row_number().over(
        one.orderBy("ctr", *[F.desc(c) for c in ties])))
    rows = (up.filter(F.col("idx") <= best).withColumn("side", F.lit("best"))
            .unionByName(down.filter(F.col("idx") <= worst).withColumn("side", F.lit("worst"))))
    return rows.withColumn("line", history_line())


def history_line() -> Column:
    q = F.lit("?")

    def shown(col, digits, unit=""):
        return F.coalesce(F.concat(fixed(col, digits), F.lit(unit)), q)

    return F.concat(
        F.lit("  "), F.col("idx"), F.lit('. hook="'), F.coalesce("hook", F.lit("(no hook)")),
        F.lit('" | ranker_score='), shown("score", 0), F.lit(" | duration="),
        fixed((F.col("end_ms") - F.col("start_ms")) / 1000, 0),
        F.lit("s | views="), F.coalesce(F.col("views").cast("string"), q),
        F.lit(" | CTR="), shown("ctr", 2, "%"), F.lit(" | watch_pct="), shown("watch_pct", 1, "%"))


def history_text(history: DataFrame) -> DataFrame:
    """The history block as one row (at most best + worst lines go into it)."""
    lines = F.array_sort(F.collect_list(F.struct("side", "idx", "line")))

    def part(side):
        return F.array_join(F.transform(F.filter("_l", lambda r: r["side"] == side),
                                        lambda r: r["line"]), "\n")

    return history.agg(lines.alias("_l")).select(F.when(F.size("_l") > 0, F.concat(
        F.lit("\n--- HISTORICAL PERFORMANCE DATA ---\n"
              "Measured results of earlier clips, for calibration.\n\n"
              "TOP PERFORMERS (highest CTR):\n"), part("best"),
        F.lit("\n\nWORST PERFORMERS (lowest CTR):\n"), part("worst"),
        F.lit("\n--- END HISTORICAL DATA ---\n"))).otherwise("").alias("history"))


# -- AN-2..7 ------------------------------------------------------------------------

def daily_views(analytics: DataFrame, as_of: int, days: int = 14) -> DataFrame:
    """Views per UTC day, one column per charted platform; a day with only other
    platforms keeps its row."""
    return (analytics.filter(F.col("fetched_at") >= as_of - days * DAY_S)
            .groupBy(F.date_format(F.timestamp_seconds("fetched_at"), "yyyy-MM-dd").alias("day"))
            .agg(*[F.coalesce(F.sum(F.when(F.col("platform") == p, F.col("views"))), F.lit(0))
                   .alias(p) for p in CHART_PLATFORMS]))


def top_clips(analytics: DataFrame, clips: DataFrame, n: int = 10, mode: str = "sum") -> DataFrame:
    """The ``n`` most viewed (clip, platform). Snapshots are cumulative; ``mode='sum'`` adds
    them up all the same, ``mode='latest'`` takes the last one.

    Only the ``n`` winners are joined with clips.
    """
    views = (F.sum("views") if mode == "sum"
             else F.max_by("views", F.struct("fetched_at", "views")))
    per = analytics.groupBy("clip_id", "platform").agg(
        views.alias("views"), F.avg("ctr").alias("_ctr"), F.avg("watch_pct").alias("_watch"))
    best = per.orderBy(F.desc_nulls_last("views"), "clip_id", "platform").limit(n)
    ranked = best.withColumn("rank", F.row_number().over(
        W.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("views"), "clip_id", "platform")))
    info = clips.select(F.col("id").alias("clip_id"), "hook", F.col("job_id").alias("episode"), "score")
    return ranked.join(info, "clip_id", "left").select(
        F.col("rank").cast("bigint").alias("rank"), "clip_id", "platform",
        F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("hook", F.lit("")).alias("hook"),
        F.coalesce(F.col("episode").cast("string"), F.lit("")).alias("episode"),
        (F.round(F.coalesce("_ctr", F.lit(0.0)) * 100) / 100).alias("ctr"),
        (F.round(F.coalesce("_watch", F.lit(0.0)) * 100) / 100).alias("watch_pct"),
        F.round(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).cast("bigint").alias("score"))


def analytics_lines(analytics: DataFrame, as_of: int) -> DataFrame:
    """One text line per snapshot with the metrics it has; rows without any are dropped."""
    def whole(col, unit):
        return F.concat(F.col(col).cast("string"), F.lit(f" {unit}"))

    parts = F.concat_ws(", ", whole("views", "views"), whole("likes", "likes"),
                        whole("reposts", "reposts"), whole("replies", "replies"),
                        F.concat(fixed("ctr", 1), F.lit("% CTR")),
                        F.concat(fixed("watch_pct", 0), F.lit("% watch")))
    hours = F.floor(F.greatest(F.lit(as_of) - F.col("fetched_at"), F.lit(0)) / 3600)
    age = F.when(hours < 1, "just now").otherwise(F.concat(F.lit("fetched "), hours, F.lit("h ago")))
    line = F.concat(F.lit("  "), F.col("platform"), F.lit(" ("), age, F.lit("): "), parts)
    return (analytics.withColumn("line", F.when(parts != "", line)).filter(F.col("line").isNotNull())
            .select("clip_id", "platform", "fetched_at", "line"))


def analytics_summary(analytics: DataFrame, as_of: int) -> DataFrame:
    """(clip_id, summary): the lines of one clip in order of time and platform.

    A clip's lines are put together day by day first, so the last step sees a text per day, not a
    row per fetch. The text is itself the result row.
    """
    together = lambda col, sep: F.array_join(F.transform(F.array_sort(F.collect_list(col)), lambda r: r["line"]), sep)
    days = analytics_lines(analytics, as_of).groupBy("clip_id", F.floor(F.col("fetched_at") / DAY_S).alias("_day")).agg(
        together(F.struct("fetched_at", "platform", "line"), "\n").alias("line"))
    return days.groupBy("clip_id").agg(together(F.struct("_day", "line"), "\n").alias("_all")).select(
        "clip_id", F.concat(F.lit("## Analytics\n\n"), "_all", F.lit("\n")).alias("summary"))


AGES_S, DUE_WINDOW_S = (24 * 3600, 72 * 3600), 3 * 3600   # fixed values


def posts_due(posts: DataFrame, analytics: DataFrame, as_of: int,
              ages=AGES_S, window: int = DUE_WINDOW_S) -> DataFrame:
    """Posts whose statistics are due at some age and not fetched near that age yet."""
    up = posts.filter((F.col("status") == "posted") & F.col("posted_at").isNotNull()
                      & (F.coalesce("external_id", F.lit("")) != ""))
    near = None
    for age in ages:
        hit = F.col("posted_at").between(as_of - age - window, as_of - age + window)
        part = up.filter(hit).withColumn("age_s", F.lit(age))
        near = part if near is None else near.unionByName(part)
    lo, hi = as_of - max(ages) - 2 * window, as_of + 2 * window
    seen = (analytics.filter(F.col("fetched_at").between(lo - max(ages), hi))
            .select(F.col("clip_id").alias("_c"), F.col("platform").alias("_p"), F.col("fetched_at").alias("_f")))
    cond = ((F.col("clip_id") == F.col("_c")) & (F.col("platform") == F.col("_p"))
            & F.col("_f").between(F.col("posted_at") + F.col("age_s") - window,
                                  F.col("posted_at") + F.col("age_s") + window))
    return near.join(seen, cond, "left_anti")


def job_board(jobs: DataFrame, clips: DataFrame, posts: DataFrame, n: int = 200) -> DataFrame:
    """The newest ``n`` jobs with clip and post counts.

    The jobs are cut to ``n`` first; children are counted per job before joining, so no
    child table is multiplied by another.
    """
    newest = jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    ids = newest.select(F.col("id").alias("job_id"))
    made = clips.join(ids, "job_id", "left_semi").groupBy("job_id").agg(F.count("*").alias("_clips"))
    sent = posts.join(ids, "job_id", "left_semi").groupBy("job_id").agg(
        F.count("*").alias("_posts"), F.count_if(F.col("status") == "posted").alias("_ok"))
    view = job_view(newest.withColumnRenamed("id", "job_id"))
    zero = F.lit(0)
    return (view.join(made, "job_id", "left").join(sent, "job_id", "left").select(
        "job_id", "show_slug", F.col("view_status").alias("status"), "stage", "progress",
        F.coalesce("_clips", zero).alias("clips_generated"), F.coalesce("_ok", zero).alias("posts_success"),
        F.coalesce("_posts", zero).alias("posts_total"), (F.col("cost_cents") / 100).alias("cost"),
        fmt_duration(F.col("updated_at") - F.col("created_at")).alias("duration"),
        fmt_iso("created_at").alias("created"), "error"))


def total_cost(jobs: DataFrame) -> DataFrame:
    return jobs.agg((F.coalesce(F.sum("cost_cents"), F.lit(0)) / 100).alias("total"))


# -- AN-8, AN-9 ---------------------------------------------------------------------

# Fixed values: (kind of match, text, USD per 1000 input tokens, per 1000 output tokens),
# first match wins.
RATE_RULES = [
    ("exact", "openai/gpt-oss-120b", 0.00015, 0.00075),
    ("exact", "openai/gpt-oss-20b", 0.000075, 0.0003),
    ("exact", "meta-llama/llama-4-scout-17b-16e-instruct", 0.00011, 0.00034),
    ("exact", "llama-3.3-70b-versatile", 0.00059, 0.00079),
    ("exact", "llama-3.1-8b-instant", 0.00005, 0.00008),
    ("exact", "qwen/qwen3-32b", 0.00029, 0.00059),
    ("exact", "whisper-large-v3-turbo", 0.000444, 0.0),
    ("exact", "whisper-large-v3", 0.00123, 0.0),
    ("prefix", "gpt-5.2-pro", 0.002, 0.010),
    ("prefix", "gpt-5", 0.002, 0.010),
    ("prefix", "gpt-4o", 0.0025, 0.010),
    ("prefix", "gpt-4", 0.01, 0.03),
    ("exact", "whisper-1", 0.004, 0.0),
    ("contains", "whisper", 0.00123, 0.0),
    ("contains", "bge", 0.0001, 0.0),
    ("contains", "embed", 0.0001, 0.0),
    ("contains", "Qwen3-VL-8B", 0.0003, 0.0006),
    ("contains", "qwen3-vl-8b", 0.0003, 0.0006),
    ("contains", "qwen2.5-vl-72b", 0.001, 0.002),
    ("contains", "Qwen2.5-VL-72B", 0.001, 0.002),
    ("contains", "claude-opus-4.7", 0.015, 0.075),
    ("contains", "claude-opus-4-7", 0.015, 0.075),
    ("contains", "claude-sonnet-4.6", 0.003, 0.015),
    ("contains", "claude-sonnet-4-6", 0.003, 0.015),
    ("contains", "claude-haiku-4.5", 0.001, 0.005),
    ("contains", "claude-haiku-4-5", 0.001, 0.005),
]
RATE_OTHER = (0.001, 0.003)            # fixed values: any other model
TOKENS_PER_SECOND, CHARS_PER_TOKEN = 25, 4   # fixed values


def rate_for(model: Column, rules=None, other=RATE_OTHER) -> Column:
    """struct(in_rate, out_rate) of a model name: an ordered CASE, so rows need no join."""
    test = {"exact": lambda p: model == p, "prefix": lambda p: model.startswith(p),
            "contains": lambda p: F.contains(model, F.lit(p))}

    def pair(a, b):
        return F.struct(F.lit(float(a)).alias("in_rate"), F.lit(float(b)).alias("out_rate"))

    out = None
    for kind, text, a, b in (rules or RATE_RULES):
        cond = test[kind](text)
        out = F.when(cond, pair(a, b)) if out is None else out.when(cond, pair(a, b))
    return pair(*other) if out is None else out.otherwise(pair(*other))


def usage_tokens(usage: DataFrame) -> DataFrame:
    """Input tokens by category: speech from seconds, embeddings from characters."""
    speech = F.round(F.col("audio_s") * TOKENS_PER_SECOND).cast("bigint")
    chars = F.floor(F.col("chars") / CHARS_PER_TOKEN).cast("bigint")
    tokens = (F.when(F.col("category") == "stt", speech)
              .when(F.col("category") == "embeddings", chars).otherwise(F.col("input_tokens")))
    told = F.col("category").isin("stt", "embeddings")
    return (usage.withColumn("input_tokens", tokens)
            .withColumn("output_tokens", F.when(told, F.lit(0)).otherwise(F.col("output_tokens"))))


def cost_by_category(usage: DataFrame, rules=None) -> DataFrame:
    """Calls, tokens and cents per (job, category).

    One aggregate, combined on the map side, so every (job, category) of a task moves once. Money is
    added up as decimals, so the total does not depend on the order of the rows.
    """
    exact = "decimal(12,9)"
    rated = usage_tokens(usage).withColumn("r", rate_for(F.col("model"), rules))
    dollars = F.sum(F.col("input_tokens") * F.col("r.in_rate").cast(exact) + F.col("output_tokens") * F.col("r.out_rate").cast(exact))
    return rated.groupBy("job_id", "category").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        (dollars.cast("double") / 10).alias("cost_cents"))      # per 1000 tokens, in cents


def job_cost(costs: DataFrame) -> DataFrame:
    return costs.groupBy("job_id").agg(
        F.round(F.sum("cost_cents")).cast("bigint").alias("cost_cents"), F.sum("calls").alias("calls"))


# -- AN-10..16 ----------------------------------------------------------------------

def show_loudness(measurements: DataFrame) -> DataFrame:
    return measurements.groupBy("show_slug").agg(
        F.avg("lufs").alias("integrated_lufs"), F.max("measured_at").alias("measured_at"),
        F.count("*").alias("episode_count"))


def merge_show_loudness(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fold new measurements into the stored averages by (sum, n)."""
    both = (current.select("show_slug", (F.col("integrated_lufs") * F.col("episode_count")).alias("_s"),
                           F.col("episode_count").alias("_n"), "measured_at")
            .unionByName(show_loudness(fresh).select(
                "show_slug", (F.col("integrated_lufs") * F.col("episode_count")).alias("_s"),
                F.col("episode_count").alias("_n"), "measured_at")))
    return both.groupBy("show_slug").agg(
        (F.sum("_s") / F.sum("_n")).alias("integrated_lufs"), F.max("measured_at").alias("measured_at"),
        F.sum("_n").alias("episode_count"))


def clip_views(analytics: DataFrame) -> DataFrame:
    """Latest views of each (clip, platform), added up per clip."""
    last = analytics.groupBy("clip_id", "platform").agg(
        F.max_by("views", F.struct("fetched_at", "views")).alias("_v"))
    return last.groupBy("clip_id").agg(F.sum("_v").alias("views"))


def trend_lift(clips: DataFrame, analytics: DataFrame, trends: DataFrame) -> DataFrame:
    """Per matched trend: sources, matched clips, mean views and lift over unmatched clips."""
    seen = (clips.select(F.col("id").alias("clip_id"), "trend_match")
            .join(clip_views(analytics), "clip_id"))
    base = seen.filter(F.col("trend_match").isNull()).agg(F.avg("views").alias("_base"))
    per = seen.filter(F.col("trend_match").isNotNull()).groupBy("trend_match").agg(
        F.count("*").alias("matched_clips"), F.avg("views").alias("avg_views"))
    sources = trends.groupBy(F.col("topic_id").alias("trend_match")).agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return (per.join(sources, "trend_match")
            .select(F.col("trend_match").alias("trend"), "sources", "matched_clips", "avg_views",
                    (F.col("avg_views") / base.scalar() - 1).alias("lift")))


def score_histogram(clips: DataFrame, score: str = "score") -> DataFrame:
    b = F.least(F.floor(F.col(score) / 10), F.lit(9))
    return (clips.filter(F.col(score).isNotNull()).groupBy(b.cast("bigint").alias("bin"))
            .agg(F.count("*").alias("n")))


def lane_delta(ranked: DataFrame, first: str = "llm_score", second: str = "vlm_score") -> DataFrame:
    """Mean second-minus-first score per episode."""
    d = F.col(second) - F.col(first)
    return (ranked.filter(d.isNotNull()).groupBy("episode_id")
            .agg(F.avg(d).alias("mean_delta"), F.count("*").alias("n")))


def rank_delta(ranked: DataFrame, first: str = "llm_score", second: str = "vlm_score",
               ties: str = "candidate_index") -> DataFrame:
    """Rank by each score within the episode and their difference.

    Rows are numbered over ranges of (score, tie) that are cut where the rows are, so a score that
    every row has is numbered by many tasks.
    """
    both = ranked.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    both = numbered(both, ["episode_id"], [F.desc(first), ties], "first_rank")
    both = numbered(both, ["episode_id"], [F.desc(second), ties], "second_rank")
    return both.withColumn("rank_delta", F.col("first_rank") - F.col("second_rank"))


def feature_importance(rows: DataFrame, features: list[str], score: str = "score") -> DataFrame:
    """Correlation of the score with each feature, one pass over the table."""
    wide = rows.agg(*[F.corr(F.col(score).cast("double"), F.col(f).cast("double")).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation")) for f in features])
    return wide.select(F.inline(pairs))


def kpis(jobs: DataFrame, clips: DataFrame, posts: DataFrame, analytics: DataFrame, as_of: int) -> DataFrame:
    """One row of headline numbers; each table is aggregated once, as a scalar subquery."""
    c = clips.agg(F.struct(
        F.count_if((F.col("created_at") >= as_of - 7 * DAY_S) & (F.col("created_at") <= as_of)).alias("week"),
        F.count("*").alias("n"))).scalar()
    p = posts.agg(F.count_if(F.col("status") == "posted")).scalar()
    a = analytics.filter(F.col("views") > 0).agg(
        F.struct(F.avg("ctr").alias("ctr"), F.avg("watch_pct").alias("watch"))).scalar()
    row = jobs.agg(F.count_if(~F.col("status").isin("done", "failed", "cancelled")).alias("active_jobs"),
                   (F.coalesce(F.sum("cost_cents"), F.lit(0)) / 100).alias("_cost"))
    row = row.select("*", c.alias("_c"), p.alias("posts_published"), a.alias("_a"))
    return row.select("active_jobs", F.col("_c.week").alias("clips_7d"), "posts_published",
                      F.col("_a.ctr").alias("avg_ctr"), F.col("_a.watch").alias("avg_watch"),
                      F.when(F.col("_c.n") > 0, F.col("_cost") / F.col("_c.n")).otherwise(0.0)
                      .alias("cost_per_clip"))


def hook_type_report(clips: DataFrame, analytics: DataFrame) -> DataFrame:
    """Views and click rate per (show, hook type)."""
    per = analytics.groupBy("clip_id").agg(
        F.sum("views").alias("_v"), F.sum("ctr").alias("_c"), F.count("ctr").alias("_n"))
    return (clips.select(F.col("id").alias("clip_id"), "show_slug", "hook_type").join(per, "clip_id")
            .groupBy("show_slug", "hook_type").agg(
                F.count("*").alias("clips"), F.sum("_v").alias("views"),
                (F.sum("_c") / F.sum("_n")).alias("avg_ctr")))


# -- RPT-1, RPT-2 -------------------------------------------------------------------

RENDER_FIELDS = ("variant", "path", "url", "bytes", "duration_ms")
POST_FIELDS = ("platform", "status", "external_id", "external_url", "posted_at", "error")


def clip_details(clips: DataFrame, jobs: DataFrame, renders: DataFrame, posts: DataFrame, status: str | None = None,
                 render_fields: tuple[str, ...] = RENDER_FIELDS, post_fields: tuple[str, ...] = POST_FIELDS, by_job: bool = False) -> DataFrame:
    """Clips with their job (show_slug, media_name, job_status) and nested renders and posts.

    Jobs join first, while clips are slim. Clips and children then move once, as one table sorted by
    clip: nothing is gathered before it has moved. Renders and posts per clip are bounded by the
    number of variants and targets; of them only the fields named move, and without any their table
    and its column are left out. Of ``posts`` and ``jobs`` the
    columns external_url, error and media_name may be missing; they are then NULL.

    ``by_job``, for children that name their clip's job_id: clips and children move to the job and
    meet it there, so that what joins by job later (``enrich_clips``) does not move them again.
    """
    def text(df, name):
        return F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name)

    if status is not None:
        clips = clips.filter(F.col("status") == status)
    own = [c for c in clips.withColumnRenamed("id", "clip_id").columns if c != "job_id"]
    j = jobs.select(F.col("id").alias("job_id"), "show_slug", text(jobs, "media_name"), F.col("status").alias("job_status"))
    keys = ["job_id", "clip_id"] if by_job else ["clip_id"]
    with_job = lambda df: df.join(j, "job_id", "left")
    rows = clips.withColumnRenamed("id", "clip_id").withColumn("_clip", F.lit(True))
    rows = rows if by_job else with_job(rows)
    lists = {}
    for name, df, fields in (("_render", renders, render_fields), ("_post", posts, post_fields)):
        if fields:
            child = df.filter(F.col("clip_id").isNotNull()).select(*keys, F.struct(*[text(df, f) for f in fields]).alias(name))
            rows = rows.unionByName(child, True)
            lists[f"{name[1:]}s"] = F.collect_list(name).over(W.partitionBy(*keys))
    rows = rows.repartition("job_id") if by_job else rows
    found = rows.select("*", *[c.alias(f"_{n}") for n, c in lists.items()]).filter("_clip")
    return (with_job(found) if by_job else found).select("job_id", *own, *[F.array_sort(f"_{n}").alias(n) for n in lists], "show_slug", "media_name", "job_status")


def media_url(path: Column, work_root: str) -> Column:
    """Address of a file below the work folder's ``clipper``; NULL for any other path."""
    root = f"{work_root.rstrip('/')}/clipper/"
    return F.when(F.startswith(path, F.lit(root)), F.concat(F.lit("/media/clipper/"), F.substring(path, F.lit(len(root) + 1), F.length(path))))


def enrich_clips(details: DataFrame, manifest_clips: DataFrame, work_root: str) -> DataFrame:
    """``clip_details`` with addresses of media, cover_url, social, overlay_hook, hook_source, scores
    and has_words from the stored manifest.

    ``manifest_clips`` as of ``read_manifests``, its episodes the jobs; of clips of one rank the first
    in the manifest counts. Only a clip with a rendered variant and a rank has one. Addresses that
    the row has win: its own, then from its path, then from the manifest's cover. ``details`` may lack
    cover_url and cover_path. What the manifests say moves to the job, where details lie ``by_job``.
    """
    def text(name):
        return F.col(name) if name in details.columns else F.lit(None).cast("string")

    variants = F.transform("renders", lambda r: F.struct(
        r["variant"].alias("variant"), r["path"].alias("path"), F.coalesce(r["url"], media_url(r["path"], work_root)).alias("url"),
        r["bytes"].alias("bytes"), r["duration_ms"].alias("duration_ms")))
    taken = F.struct("social", "overlay_hook", "hook_source", "scores", F.col("cover_frame.abs_path").alias("_cover"), (F.size("words") > 0).alias("_words"))
    said = manifest_clips.select(F.col("episode_id").alias("job_id"), "rank", "pos", taken.alias("_m")).repartition("job_id")
    first = said.groupBy("job_id", "rank").agg(F.min_by("_m", "pos").alias("_m")).groupBy("job_id").agg(F.collect_list(F.struct("rank", "_m")).alias("_said"))
    out = details.withColumn("variants", variants).withColumn("_row_cover", F.coalesce(text("cover_url"), media_url(text("cover_path"), work_root)))
    of_rank = F.get(F.filter("_said", lambda m: m["rank"] == F.col("rank")), F.lit(0))["_m"]
    out = out.join(first, "job_id", "left").withColumn("_m", F.when(F.size("renders") > 0, of_rank))
    fields = [F.col(f"_m.{c}").alias(c) for c in ("social", "overlay_hook", "hook_source", "scores")]
    kept = [c for c in details.columns if c not in ("cover_url",)]
    return out.select(*kept, "variants", F.coalesce("_row_cover", media_url(F.col("_m._cover"), work_root)).alias("cover_url"), *fields,
                      F.coalesce("_m._words", F.lit(False)).alias("has_words"))


def newest_jobs(jobs: DataFrame, n: int = 200) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def clips_in_order(clips: DataFrame) -> DataFrame:
    return clips.orderBy(F.asc_nulls_last("rank"), "id")


def failed_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "failed").orderBy(F.desc("updated_at"), "id")

