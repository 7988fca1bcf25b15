"""AN-1..16, RPT-1..2, TR-1..5 and the report joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import trends as TR
from ..session import shared_dir
from ..sinks import tables as S
from . import tables as t
from .catalog import query
from .source_queries import all_manifests, clip_manifests, renders
from .tables import sql

NOW = 1_705_708_800      # 2024-01-20 00:00 UTC


HISTORY_LINES = """SELECT side, idx, clip_id, line FROM (SELECT *,
   '  ' || idx || '. hook="' || coalesce(hook, '(no hook)') || '" | ranker_score=' || coalesce(printf('%.0f', score::DOUBLE), '?') || ' | duration=' ||
   printf('%.0f', (end_ms - start_ms) / 1000) || 's | views=' || coalesce(views::VARCHAR, '?') || ' | CTR=' || printf('%.2f%%', ctr) ||
   ' | watch_pct=' || coalesce(printf('%.1f%%', watch_pct), '?') AS line FROM (
     SELECT 'best' AS side, row_number() OVER (ORDER BY ctr DESC, clip_id, platform, fetched_at) AS idx, * FROM top
     UNION ALL SELECT 'worst', row_number() OVER (ORDER BY ctr, clip_id DESC, platform DESC, fetched_at DESC), * FROM top)
   WHERE idx <= CASE side WHEN 'best' THEN 5 ELSE 3 END)"""
HISTORY_TOP = """top AS (SELECT c.hook, c.score, c.start_ms, c.end_ms, s.clip_id, s.platform, s.fetched_at, s.views, s.ctr, s.watch_pct
   FROM stat_clips c JOIN stats s ON s.clip_id = c.id WHERE s.ctr IS NOT NULL ORDER BY ctr DESC, clip_id, platform, fetched_at LIMIT 18)"""


@query("an_01_performance_history", sql(HISTORY_LINES, "stats", "stat_clips", extra=HISTORY_TOP))
def an1(spark, sf):
    h = R.performance_history(t.stat_clips(spark, sf), t.analytics(spark, sf))
    return h.select("side", F.col("idx").cast("bigint").alias("idx"), "clip_id", "line")


@query("an_02_daily_views", sql(f"""SELECT strftime(make_timestamp(fetched_at * 1000000), '%Y-%m-%d') AS day, {', '.join(
    f"CAST(coalesce(sum(views) FILTER (platform = '{p}'), 0) AS BIGINT) AS {p}" for p in R.CHART_PLATFORMS)}
   FROM stats WHERE fetched_at >= {NOW} - 14 * 86400 GROUP BY ALL""", "stats"))
def an2(spark, sf):
    return R.daily_views(t.analytics(spark, sf), NOW)


_TOP = """WITH a AS (SELECT clip_id, platform, CAST({views} AS BIGINT) AS views, avg(ctr) AS c, avg(watch_pct) AS w FROM stats GROUP BY ALL),
   b AS (SELECT *, row_number() OVER (ORDER BY views DESC, clip_id, platform) AS rank FROM a)
   SELECT rank, clip_id, platform, coalesce(views, 0) AS views, coalesce(hook, '') AS hook, coalesce(job_id::VARCHAR, '') AS episode,
   round(coalesce(c, 0) * 100) / 100 AS ctr, round(coalesce(w, 0) * 100) / 100 AS watch_pct, CAST(round(coalesce(score, 0)) AS BIGINT) AS score
   FROM b LEFT JOIN (SELECT id, hook, job_id, score FROM stat_clips) ON id = clip_id WHERE rank <= 10"""


def _top_sql(views):
    return sql("", "stats", "stat_clips").rstrip() + ", " + _TOP.replace("{views}", views).replace("WITH ", "", 1)


@query("an_03_top_clips", _top_sql("sum(views)"))
def an3(spark, sf):
    return R.top_clips(t.analytics(spark, sf), t.stat_clips(spark, sf))


@query("an_03_top_clips_latest", _top_sql("arg_max(views, fetched_at * 100000000 + views)"))
def an3b(spark, sf):
    return R.top_clips(t.analytics(spark, sf), t.stat_clips(spark, sf), mode="latest")


@query("an_04_analytics_lines", sql(f"""SELECT clip_id, platform, fetched_at, '  ' || platform || ' (' || CASE WHEN h < 1 THEN 'just now' ELSE 'fetched ' || h || 'h ago' END
   || '): ' || concat_ws(', ', views || ' views', likes || ' likes', reposts || ' reposts', replies || ' replies',
   printf('%.1f%% CTR', ctr), printf('%.0f%% watch', watch_pct)) AS line
   FROM (SELECT *, greatest({NOW} - fetched_at, 0) // 3600 AS h FROM stats)""", "stats"))
def an4(spark, sf):
    return R.analytics_lines(t.analytics(spark, sf), NOW)


@query("an_04_summary", sql(f"""SELECT clip_id, '## Analytics' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY fetched_at, platform, line) || chr(10) AS summary FROM (
     SELECT clip_id, platform, fetched_at, '  ' || platform || ' (' || CASE WHEN h < 1 THEN 'just now' ELSE 'fetched ' || h || 'h ago' END
     || '): ' || concat_ws(', ', views || ' views', likes || ' likes', reposts || ' reposts', replies || ' replies',
     printf('%.1f%% CTR', ctr), printf('%.0f%% watch', watch_pct)) AS line
     FROM (SELECT *, greatest({NOW} - fetched_at, 0) // 3600 AS h FROM stats)) GROUP BY clip_id""", "stats"))
def an4_summary(spark, sf):
    return R.analytics_summary(t.analytics(spark, sf), NOW)


@query("an_05_posts_due", sql(f"""SELECT p.clip_id, p.platform, p.posted_at, CAST(a.age AS BIGINT) AS age_s FROM stat_posts p, (VALUES (86400), (259200)) a(age)
   WHERE status = 'posted' AND external_id <> '' AND posted_at BETWEEN {NOW - 17 * 86400} - age - 10800 AND {NOW - 17 * 86400} - age + 10800 AND NOT EXISTS (
     SELECT 1 FROM stats s WHERE s.clip_id = p.clip_id AND s.platform = p.platform
     AND s.fetched_at BETWEEN p.posted_at + age - 10800 AND p.posted_at + age + 10800)""", "stats", "stat_posts"))
def an5(spark, sf):
    due = R.posts_due(t.stat_posts(spark, sf), t.analytics(spark, sf), NOW - 17 * 86_400)
    return due.select("clip_id", "platform", "posted_at", F.col("age_s").cast("bigint").alias("age_s"))


@query("jn_07_posts_never_fetched", sql("""SELECT p.clip_id, p.platform FROM stat_posts p WHERE NOT EXISTS (SELECT 1 FROM stats s
   WHERE s.clip_id = p.clip_id AND s.platform = p.platform AND s.fetched_at BETWEEN p.posted_at + 259200 - 86400 AND p.posted_at + 259200 + 86400)""", "stats", "stat_posts"))
def jn7(spark, sf):
    p = t.stat_posts(spark, sf)
    s = t.analytics(spark, sf).select(F.col("clip_id").alias("c"), F.col("platform").alias("q"), F.col("fetched_at").alias("f"))
    cond = ((F.col("clip_id") == F.col("c")) & (F.col("platform") == F.col("q"))
            & F.col("f").between(F.col("posted_at") + 172_800, F.col("posted_at") + 345_600))
    return p.join(s, cond, "left_anti").select("clip_id", "platform")


@query("an_06_job_board", sql("""SELECT j.id AS job_id, show_slug, coalesce(c.n, 0) AS clips_generated, CAST(coalesce(p.ok, 0) AS BIGINT) AS posts_success,
   coalesce(p.n, 0) AS posts_total, cost_cents / 100 AS cost,
   ((updated_at - created_at) // 60) || 'm ' || ((updated_at - created_at) % 60) || 's' AS duration, error
   FROM (SELECT * FROM jobs ORDER BY created_at DESC, id DESC LIMIT 200) j
   LEFT JOIN (SELECT job_id, count(*) AS n FROM clips GROUP BY ALL) c ON c.job_id = j.id
   LEFT JOIN (SELECT job_id, count(*) AS n, count(*) FILTER (status = 'posted') AS ok FROM clip_posts GROUP BY ALL) p ON p.job_id = j.id""",
                                "jobs", "clips", "clip_posts"))
def an6(spark, sf):
    b = R.job_board(t.jobs(spark, sf), t.clips(spark, sf), t.clip_posts(spark, sf))
    return b.select("job_id", "show_slug", "clips_generated", "posts_success", "posts_total", "cost", "duration", "error")


@query("an_07_total_cost", sql("SELECT coalesce(sum(cost_cents), 0)::DOUBLE / 100 AS total FROM jobs", "jobs"))
def an7(spark, sf):
    return R.total_cost(t.jobs(spark, sf))


_RATE = """CASE model WHEN 'qwen/qwen3-32b' THEN {0} WHEN 'whisper-large-v3-turbo' THEN {1} WHEN 'whisper-large-v3' THEN {2}
   WHEN 'gpt-5-nano' THEN {3} WHEN 'gpt-4o-mini' THEN {4} WHEN 'whisper-x' THEN {2} WHEN 'bge-m3' THEN {5} ELSE {6} END"""
_RIN = _RATE.format(0.00029, 0.000444, 0.00123, 0.002, 0.0025, 0.0001, 0.001)
_ROUT = _RATE.format(0.00059, 0.0, 0.0, 0.010, 0.010, 0.0, 0.003)


@query("an_08_cost_by_category", sql(f"""SELECT job_id, category, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
   round(CAST(sum(i * ({_RIN})::DECIMAL(12, 9) + o * ({_ROUT})::DECIMAL(12, 9)) AS DOUBLE) / 10, 6) AS cost_cents FROM (SELECT *,
     CASE category WHEN 'stt' THEN CAST(round(audio_s * 25) AS BIGINT) WHEN 'embeddings' THEN chars // 4 ELSE input_tokens END AS i,
     CASE WHEN category IN ('stt', 'embeddings') THEN 0 ELSE output_tokens END AS o FROM usage) GROUP BY job_id, category""", "usage"))
def an8(spark, sf):
    c = R.cost_by_category(t.usage(spark, sf))
    return c.withColumn("cost_cents", F.round("cost_cents", 6))


@query("an_09_rate_for", sql(f"SELECT DISTINCT model, ({_RIN})::DOUBLE AS in_rate, ({_ROUT})::DOUBLE AS out_rate FROM usage", "usage"))
def an9(spark, sf):
    m = t.usage(spark, sf).select("model").distinct().withColumn("r", R.rate_for(F.col("model")))
    return m.select("model", "r.in_rate", "r.out_rate")


@query("an_10_show_loudness", """SELECT 'show_' || c_nationkey AS show_slug, round(avg(c_acctbal), 6) AS integrated_lufs,
   max(c_custkey) AS measured_at, count(*) AS episode_count FROM customer GROUP BY ALL""")
def an10(spark, sf):
    m = t.read(spark, sf, "customer").select(F.concat(F.lit("show_"), "c_nationkey").alias("show_slug"),
                                             F.col("c_acctbal").alias("lufs"), F.col("c_custkey").alias("measured_at"))
    return R.show_loudness(m).withColumn("integrated_lufs", F.round("integrated_lufs", 6))


@query("an_10_merged_loudness", """SELECT 'show_' || c_nationkey AS show_slug, round(avg(c_acctbal), 6) AS integrated_lufs,
   max(c_custkey) AS measured_at, count(*) AS episode_count FROM customer GROUP BY ALL""")
def an10_merged(spark, sf):
    """Stored averages of two thirds of the measurements, the others folded in."""
    m = t.read(spark, sf, "customer").select(F.concat(F.lit("show_"), "c_nationkey").alias("show_slug"),
                                             F.col("c_acctbal").alias("lufs"), F.col("c_custkey").alias("measured_at"))
    stored = R.show_loudness(m.filter(F.col("measured_at") % 3 != 0))
    return R.merge_show_loudness(stored, m.filter(F.col("measured_at") % 3 == 0)).withColumn("integrated_lufs", F.round("integrated_lufs", 6))


_VIEWS = """v AS (SELECT clip_id, CAST(sum(x) AS BIGINT) AS views FROM (SELECT clip_id, platform,
   arg_max(views, fetched_at * 100000000 + views) AS x FROM stats GROUP BY ALL) GROUP BY clip_id)"""


@query("an_11_trend_lift", sql("""SELECT trend_match AS trend, sources, n AS matched_clips, round(m, 6) AS avg_views,
   round(m / (SELECT avg(views) FROM stat_clips JOIN v ON clip_id = id WHERE trend_match IS NULL) - 1, 6) AS lift
   FROM (SELECT trend_match, count(*) AS n, avg(views) AS m FROM stat_clips JOIN v ON clip_id = id WHERE trend_match IS NOT NULL GROUP BY ALL)
   JOIN (SELECT topic_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM trends GROUP BY ALL) ON topic_id = trend_match""",
                                 "stats", "stat_clips", "trends", extra=_VIEWS))
def an11(spark, sf):
    r = R.trend_lift(t.stat_clips(spark, sf), t.analytics(spark, sf), t.trends(spark, sf))
    return r.withColumn("avg_views", F.round("avg_views", 6)).withColumn("lift", F.round("lift", 6))


@query("an_12_score_histogram", sql("SELECT CAST(least(score // 10, 9) AS BIGINT) AS bin, count(*) AS n FROM clips GROUP BY ALL", "clips"))
def an12(spark, sf):
    return R.score_histogram(t.clips(spark, sf))


def lanes(spark, sf):
    """Two scores per clip of each job; every sixth has no second score."""
    return t.clips(spark, sf).select(
        F.col("job_id").alias("episode_id"), F.col("id").alias("candidate_index"), F.col("score").alias("llm_score"),
        F.when(F.col("start_ms") % 600 != 0, (F.col("start_ms") / 100) % 101).cast("bigint").alias("vlm_score"))


_LANES = """lanes AS (SELECT job_id AS episode_id, id AS candidate_index, score AS llm_score,
   CASE WHEN start_ms % 600 <> 0 THEN (start_ms // 100) % 101 END AS vlm_score FROM clips)"""


@query("an_13_lane_delta", sql("""SELECT episode_id, round(avg(vlm_score - llm_score), 6) AS mean_delta, count(*) AS n FROM lanes
   WHERE vlm_score IS NOT NULL GROUP BY ALL""", "clips", extra=_LANES))
def an13(spark, sf):
    return R.lane_delta(lanes(spark, sf)).withColumn("mean_delta", F.round("mean_delta", 6))


@query("an_13_rank_delta", sql("""SELECT episode_id, candidate_index, row_number() OVER (PARTITION BY episode_id ORDER BY llm_score DESC, candidate_index) AS first_rank,
   row_number() OVER (PARTITION BY episode_id ORDER BY vlm_score DESC, candidate_index) AS second_rank FROM lanes WHERE vlm_score IS NOT NULL""", "clips", extra=_LANES))
def an13b(spark, sf):
    return R.rank_delta(lanes(spark, sf)).select("episode_id", "candidate_index", "first_rank", "second_rank")


@query("an_14_feature_importance", sql("""SELECT unnest(['tax', 'rank', 'length']) AS feature, unnest([round(corr(score, tax), 6), round(corr(score, rank), 6),
   round(corr(score, end_ms - start_ms), 6)]) AS correlation FROM clips""", "clips"))
def an14(spark, sf):
    c = t.clips(spark, sf).withColumn("length", F.col("end_ms") - F.col("start_ms"))
    return R.feature_importance(c, ["tax", "rank", "length"]).withColumn("correlation", F.round("correlation", 6))


@query("an_15_kpis", sql("""SELECT (SELECT count(*) FROM jobs WHERE status NOT IN ('done', 'failed', 'cancelled')) AS active_jobs,
   (SELECT count(*) FROM clips WHERE created_at BETWEEN 900000000 - 7 * 86400 AND 900000000) AS clips_7d,
   (SELECT count(*) FROM clip_posts WHERE status = 'posted') AS posts_published, (SELECT round(avg(ctr), 6) FROM stats WHERE views > 0) AS avg_ctr,
   (SELECT round(avg(watch_pct), 6) FROM stats WHERE views > 0) AS avg_watch,
   round((SELECT sum(cost_cents)::DOUBLE FROM jobs) / 100 / (SELECT count(*) FROM clips), 6) AS cost_per_clip""", "jobs", "clips", "clip_posts", "stats"))
def an15(spark, sf):
    k = R.kpis(t.jobs(spark, sf), t.clips(spark, sf), t.clip_posts(spark, sf), t.analytics(spark, sf), 900_000_000)
    return k.select("active_jobs", "clips_7d", "posts_published", *[F.round(c, 6).alias(c) for c in ("avg_ctr", "avg_watch", "cost_per_clip")])


@query("an_16_hook_types", sql("""SELECT show_slug, hook_type, count(*) AS clips, CAST(sum(v) AS BIGINT) AS views, round(sum(c) / sum(n), 6) AS avg_ctr
   FROM stat_clips JOIN (SELECT clip_id, sum(views) AS v, sum(ctr) AS c, count(ctr) AS n FROM stats GROUP BY ALL) ON clip_id = id GROUP BY ALL""", "stats", "stat_clips"))
def an16(spark, sf):
    return R.hook_type_report(t.stat_clips(spark, sf), t.analytics(spark, sf)).withColumn("avg_ctr", F.round("avg_ctr", 6))


_RENDERS = """renders AS (SELECT id AS clip_id, unnest(['9x16', '1x1']) AS variant, job_id, end_ms - start_ms AS d FROM clips WHERE hook_type IS NOT NULL)"""


def details(spark, sf, **fields):
    jobs = t.jobs(spark, sf).withColumn("media_name", F.concat(F.lit("media "), "id"))
    posts = t.clip_posts(spark, sf).withColumn("external_url", F.concat(F.lit("https://"), "platform", F.lit("/"), "external_id")).withColumn(
        "error", F.when(F.col("status") == "failed", "oops"))
    return R.clip_details(t.clips(spark, sf), jobs, renders(spark, sf), posts, **fields)


@query("rpt_01_clip_details", sql("""SELECT c.id AS clip_id, c.job_id, j.status AS job_status, 'media ' || j.id AS media_name, (SELECT count(*) FROM renders r WHERE r.clip_id = c.id) AS n_renders,
   (SELECT string_agg(platform || ':' || p.status || coalesce(':https://' || platform || '/' || external_id, '') || CASE WHEN p.status = 'failed' THEN ':oops' ELSE '' END, ',' ORDER BY platform) FROM clip_posts p WHERE p.clip_id = c.id) AS posts
   FROM clips c LEFT JOIN jobs j ON j.id = c.job_id""", "clips", "jobs", "clip_posts", extra=_RENDERS))
def rpt1(spark, sf):
    shown = details(spark, sf, render_fields=("variant",), post_fields=("platform", "status", "external_url", "error"))
    return shown.select("clip_id", "job_id", "job_status", "media_name", F.size("renders").cast("bigint").alias("n_renders"), F.array_join(
        F.transform("posts", lambda p: F.concat_ws(":", p["platform"], p["status"], p["external_url"], p["error"])), ",").alias("posts"))


@query("rpt_02_enrich_clips", sql("""SELECT c.id AS clip_id, (SELECT string_agg(CASE variant WHEN '1x1' THEN 'https://cdn/' || clip_id ELSE
     '/media/clipper/' || r.job_id || '/' || clip_id || '_' || variant || '.mp4' END, ',' ORDER BY variant) FROM renders r WHERE r.clip_id = c.id) AS urls,
   coalesce(hook_type IS NOT NULL, false) AS has_words, CASE WHEN hook_type IS NOT NULL THEN m.score END AS blended,
   CASE WHEN hook_type IS NOT NULL THEN CASE WHEN m.score % 3 = 0 THEN coalesce('over ' || m.hook, '') ELSE '' END END AS overlay_hook,
   CASE WHEN hook_type IS NOT NULL THEN CASE WHEN m.score % 3 = 0 THEN 'llm' ELSE '' END END AS hook_source,
   CASE WHEN hook_type IS NOT NULL AND m.score % 3 = 0 THEN 'tiktok ' || m.rank END AS caption,
   CASE score % 4 WHEN 0 THEN 'https://cover/' || c.id WHEN 1 THEN '/media/clipper/own/' || c.id || '.jpg' ELSE CASE WHEN hook_type IS NOT NULL AND c.rank % 2 = 1 THEN '/media/clipper/' || c.job_id || '/' || m.id || '.jpg' END END AS cover_url
   FROM clips c LEFT JOIN (SELECT job_id, rank, arg_min(m, m.id) AS m FROM (SELECT job_id, rank, {'id': id, 'score': score, 'hook': hook, 'rank': rank} AS m FROM clips) GROUP BY ALL) m ON m.job_id = c.job_id AND m.rank = c.rank""",
                                    "clips", extra=_RENDERS))
def rpt2(spark, sf):
    """Beside the manifests as snk_02 writes them."""
    path = f"{shared_dir(spark, 'manifests')}/table"
    S.write_manifests(clip_manifests(spark, sf), path)
    known = all_manifests(spark, path)
    n, ident = F.col("score") % 4, F.col("clip_id")
    rows = details(spark, sf, post_fields=(), by_job=True).withColumn("cover_url", F.when(n == 0, F.concat(F.lit("https://cover/"), ident))).withColumn(
        "cover_path", F.when(n == 1, F.concat(F.lit("/work/clipper/own/"), ident, F.lit(".jpg"))).when(n == 2, F.concat(F.lit("/elsewhere/"), ident)))
    e = R.enrich_clips(rows, known, "/work")
    urls = F.array_join(F.transform("variants", lambda v: v["url"]), ",")
    return e.select("clip_id", F.when(F.size("variants") > 0, urls).alias("urls"), "has_words", "scores.blended", "overlay_hook", "hook_source",
                    F.col("social.tiktok.caption").alias("caption"), "cover_url")


@query("sort_newest_jobs", sql("SELECT id, created_at FROM jobs ORDER BY created_at DESC, id DESC LIMIT 200", "jobs"))
def sort1(spark, sf):
    return R.newest_jobs(t.jobs(spark, sf)).select("id", "created_at")


@query("sort_failed_jobs", sql("SELECT id, updated_at FROM jobs WHERE status = 'failed' ORDER BY updated_at DESC, id", "jobs"))
def sort2(spark, sf):
    return R.failed_jobs(t.jobs(spark, sf)).select("id", "updated_at")


@query("sort_clips_by_rank", sql("SELECT id, rank FROM clips ORDER BY rank ASC NULLS LAST, id", "clips"))
def sort3(spark, sf):
    return R.clips_in_order(t.clips(spark, sf)).select("id", "rank")


# -- TR -----------------------------------------------------------------------------

@query("tr_01_recent_trends", sql("""SELECT source, topic_id, score, fetched_at FROM trends t WHERE fetched_at = (SELECT max(fetched_at) FROM trends u
   WHERE u.source = t.source AND u.topic_id = t.topic_id) ORDER BY score DESC, source, topic_id LIMIT 50""", "trends"))
def tr1(spark, sf):
    return TR.recent_trends(t.trends(spark, sf), 50).select("source", "topic_id", "score", "fetched_at")


@query("jn_08_latest_per_topic", sql("""SELECT source, topic_id, label, score, fetched_at FROM trends t WHERE fetched_at = (SELECT max(fetched_at) FROM trends u
   WHERE u.source = t.source AND u.topic_id = t.topic_id)""", "trends"))
def jn8(spark, sf):
    return TR.latest_per_topic(t.trends(spark, sf))


def hourly(spark, sf):
    """Trend rows fetched in hourly batches: the last score of each topic in the hour."""
    h = t.trends(spark, sf).withColumn("hour", F.floor(F.col("fetched_at") / 3600) * 3600)
    return h.groupBy("source", "topic_id", F.col("hour").alias("fetched_at")).agg(
        F.max_by("label", "fetched_at").alias("label"), F.max_by("score", "fetched_at").alias("score"))


_HOURLY = """hourly AS (SELECT source, topic_id, fetched_at // 3600 * 3600 AS fetched_at, arg_max(label, fetched_at) AS label,
   arg_max(score, fetched_at) AS score FROM trends GROUP BY source, topic_id, trends.fetched_at // 3600 * 3600)"""


@query("tr_02_latest_batch", sql("""SELECT source, topic_id, label, score, fetched_at FROM hourly h WHERE fetched_at = (SELECT max(fetched_at) FROM hourly i
   WHERE i.source = h.source)""", "trends", extra=_HOURLY))
def tr2(spark, sf):
    return TR.latest_batch(hourly(spark, sf)).select("source", "topic_id", "label", "score", "fetched_at")


@query("tr_03_source_freshness", sql(f"""SELECT s AS source, coalesce(m, 0) AS last_fetched, {NOW} - coalesce(m, 0) AS age_s, {NOW} - coalesce(m, 0) < 86400 AS fresh
   FROM (VALUES ('view'), ('click'), ('never')) v(s) LEFT JOIN (SELECT source, max(fetched_at) AS m FROM trends GROUP BY ALL) ON source = s""", "trends"))
def tr3(spark, sf):
    return TR.source_freshness(t.trends(spark, sf), NOW, ["view", "click", "never"])


@query("tr_04_current_trends", sql("""SELECT source, topic_id, label, score FROM hourly h WHERE source IN ('view', 'click', 'error') AND fetched_at =
   (SELECT max(fetched_at) FROM hourly i WHERE i.source = h.source)""", "trends", extra=_HOURLY))
def tr4(spark, sf):
    return TR.current_trends(hourly(spark, sf), ["view", "click", "error"])


@query("tr_05_trend_panel", sql(f"""SELECT source, pos, label AS topic, CASE source WHEN 'view' THEN score ELSE round(score * CASE source WHEN 'click' THEN 1000 ELSE 1000000 END) END AS value
   FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fetched_at DESC, score DESC, topic_id) AS pos FROM (
     SELECT * FROM trends WHERE fetched_at >= {NOW} - 86400 ORDER BY fetched_at DESC, score DESC, source, topic_id LIMIT 300)
     WHERE source IN ('view', 'click', 'error')) WHERE pos <= 15""", "trends"))
def tr5(spark, sf):
    p = TR.trend_panel(t.trends(spark, sf), NOW, {"view": 1.0, "click": 1_000.0, "error": 1_000_000.0})
    return p.withColumn("pos", F.col("pos").cast("bigint"))
