"""SRC-7, RK-1..7 and PST-1..4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import posting as P
from ..operators import ranking as K
from ..operators import reports as R
from ..operators import trends as TR
from ..session import stage
from ..sources import feeds
from . import tables as t
from .catalog import query
from .report_queries import HISTORY_LINES, HISTORY_TOP
from .source_queries import renders
from .tables import sql
from .timeline_queries import _GRID, wide_candidates

_CANDS = _GRID + """, cands AS (SELECT episode_id, window_id, start_ms, end_ms,
   row_number() OVER (PARTITION BY episode_id ORDER BY window_id) - 1 AS idx FROM grid)"""


def cands(spark, sf):
    g = I.grid(t.totals(spark, sf), I.WindowParams())
    return K.index_candidates(g)


@query("rk_01_rank_batches", sql("""SELECT episode_id, idx // 10 AS batch_idx, count(*) AS n, string_agg(idx % 10 || ':' || idx || ':' || printf('%.3f', start_ms / 1000) || '-' || printf('%.3f', end_ms / 1000)
     || ':' || tx || ':' || coalesce(printf('%.4f', p), '-'), ';' ORDER BY idx) AS items
   FROM (SELECT w.episode_id, w.window_id, w.start_ms, w.end_ms, coalesce(string_agg(event_type, '. ' ORDER BY t_ms, event_id), '') AS tx, max(value) FILTER (event_type = 'view') AS p,
     w.window_id AS idx
     FROM evwin w LEFT JOIN ev ON ev.episode_id = w.episode_id AND t_ms >= start_ms AND t_ms < end_ms GROUP BY ALL) GROUP BY ALL""", "ev", "evwin"))
def rk1(spark, sf):
    """Every candidate of every payload, read back; windows of an episode are numbered from 0."""
    b = K.rank_batches(stage(wide_candidates(spark, sf), "candidates"))
    items = F.from_json("payload", "array<struct<index:bigint,episode_index:bigint,start_secs:double,end_secs:double,transcript:string,prosody:struct<rms_peak_db:double>>>")
    told = F.transform(items, lambda x: F.concat(x["index"], F.lit(":"), x["episode_index"], F.lit(":"), F.format_string("%.3f", x["start_secs"]), F.lit("-"), F.format_string("%.3f", x["end_secs"]),
                                                 F.lit(":"), x["transcript"], F.lit(":"), F.when(x["prosody"]["rms_peak_db"].isNull(), "-").otherwise(F.format_string("%.4f", x["prosody"]["rms_peak_db"]))))
    return b.select("episode_id", "batch_idx", "n", F.array_join(told, ";").alias("items"))


@query("rk_02_clamp_refined", sql("""SELECT *, CASE WHEN e <= s THEN greatest(end_ms, s + 1000) ELSE e END AS new_end FROM (
   SELECT episode_id, window_id, end_ms, least(greatest(start_ms + (window_id * 1700) % 23000 - 9000, greatest(start_ms - 5000, 0)), start_ms + 5000) AS s,
   least(greatest(start_ms + (window_id * 2900) % 31000 - 9000, end_ms - 5000), end_ms + 5000) AS e FROM grid)""", "totals", extra=_GRID).replace(
    "SELECT *, CASE WHEN e <= s", "SELECT episode_id, window_id, s AS new_start, CASE WHEN e <= s"))
def rk2(spark, sf):
    g = I.grid(t.totals(spark, sf), I.WindowParams())
    w = F.col("window_id")
    s, e = K.clamp_refined(F.col("start_ms"), F.col("end_ms"), F.col("start_ms") + (w * 1700) % 23_000 - 9_000,
                           F.col("start_ms") + (w * 2900) % 31_000 - 9_000)
    return g.select("episode_id", "window_id", s.alias("new_start"), e.alias("new_end"))


_RANKED = _CANDS + """, answers AS (SELECT episode_id, idx // 10 AS batch_idx, idx % 10 AS pos, idx // 10 * 10 + CASE WHEN idx % 10 = 0 THEN 10 ELSE idx % 10 END AS target,
     (episode_id * 7 + idx * 13) % 130 - 10 AS raw, CASE WHEN idx % 5 = 0 THEN 0 ELSE start_ms + (idx % 17 - 8) * 1000 END AS ns,
     CASE WHEN idx % 5 = 0 THEN 0 ELSE end_ms + (idx % 13 - 6) * 2000 END AS ne, idx FROM cands),
   ranked0 AS (SELECT a.episode_id, a.target AS candidate_index, a.batch_idx, a.pos, least(greatest(raw, 0), 100) AS score,
     least(greatest(ns, greatest(c.start_ms - 5000, 0)), c.start_ms + 5000) AS start_ms, least(greatest(ne, c.end_ms - 5000), c.end_ms + 5000) AS e0, c.end_ms AS ce, a.idx
     FROM answers a JOIN cands c ON c.episode_id = a.episode_id AND c.idx = a.target),
   ranked AS (SELECT *, CASE WHEN e0 <= start_ms THEN greatest(ce, start_ms + 1000) ELSE e0 END AS end_ms,
     CASE WHEN idx % 3 = 0 THEN 'trend ' || idx END AS trend_match, CASE idx % 4 WHEN 0 THEN 'bold_claim' WHEN 1 THEN 'story' END AS hook_type FROM ranked0)"""


def responses(c):
    """Answers of a stand-in for the ranking model: one per batch, in its JSON form. The
    first index of a batch is off by a batch size, as models sometimes answer."""
    def clip(r):
        i = r["candidate_index"]
        return F.struct(
            F.when(r["index"] == 0, 10).otherwise(r["index"]).alias("index"),
            ((r["episode_id"] * 7 + i * 13) % 130 - 10).alias("score"), F.concat(F.lit("  hook "), i, F.lit(" ")).alias("hook"),
            F.when(i % 5 != 0, (r["start_ms"] + (i % 17 - 8) * 1000) / 1000).alias("refined_start_secs"),
            F.when(i % 5 != 0, (r["end_ms"] + (i % 13 - 6) * 2000) / 1000).alias("refined_end_secs"),
            F.lit(" why ").alias("reasoning"), F.when(i % 3 == 0, F.concat(F.lit("trend "), i)).otherwise(" ").alias("trend_match"),
            F.when(i % 4 == 0, " Bold_Claim").when(i % 4 == 1, "STORY").alias("hook_type"))

    # Numbers are gathered and the texts made from them, not the other way round.
    rows = F.array_sort(F.collect_list(F.struct("index", "candidate_index", "episode_id", "start_ms", "end_ms")))
    return c.groupBy("episode_id", "batch_idx").agg(rows.alias("_r")).select(
        "episode_id", "batch_idx", F.to_json(F.struct(F.transform("_r", clip).alias("clips"))).alias("response"))


def ranked(spark, sf, c=None):
    """Answers beside the candidates they name; the candidates are derived once."""
    c = stage(cands(spark, sf), "candidates") if c is None else c
    return feeds.read_rank_responses(responses(c), c)


@query("src_07_rank_responses", sql("SELECT episode_id, candidate_index, batch_idx, pos, start_ms, end_ms, score, trend_match, hook_type FROM ranked", "totals", extra=_RANKED))
def src7(spark, sf):
    return ranked(spark, sf).select("episode_id", "candidate_index", "batch_idx", F.col("pos").cast("bigint").alias("pos"),
                                    "start_ms", "end_ms", "score", "trend_match", "hook_type")


_TOP = _RANKED + """, top AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, batch_idx, pos) AS ord FROM ranked QUALIFY ord <= 8)"""


@query("rk_03_top_k", sql("SELECT episode_id, candidate_index, score, ord FROM top", "totals", extra=_TOP))
def rk3(spark, sf):
    return K.top_k(ranked(spark, sf), 5, 8).select("episode_id", "candidate_index", "score", F.col("ord").cast("bigint").alias("ord"))


# Second scores: the labels' quality for a document's candidates.
_LANE = _TOP + """, s1 AS (SELECT doc_id AS episode_id, candidate_index, max(quality * 60 + toxic * 30 + candidate_index % 23) AS second FROM labels
     JOIN top ON episode_id = doc_id GROUP BY ALL),
   l1 AS (SELECT t.*, CASE WHEN ord <= 6 AND second IS NOT NULL THEN CAST(least(greatest(round(0.5 * score + 0.5 * second), 0), 100) AS BIGINT) ELSE score END AS b1,
     CASE WHEN ord <= 6 AND second IS NOT NULL THEN least(second, 100) END AS vlm FROM top t LEFT JOIN s1 USING (episode_id, candidate_index)),
   o1 AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY b1 DESC, ord) AS ord1 FROM l1)"""


def second_scores(spark, sf, base):
    l = t.read(spark, sf, "labels").groupBy(F.col("doc_id").alias("episode_id")).agg(F.max(F.col("quality") * 60 + F.col("toxic") * 30).alias("_q"))
    return base.join(l, "episode_id").select("episode_id", "candidate_index", (F.col("_q") + F.col("candidate_index") % 23).alias("second"),
                                             F.lit("seen").alias("why"))


def lane_one(spark, sf, c=None):
    top = stage(K.top_k(ranked(spark, sf, c), 5, 8), "top")
    base = top.select("episode_id", "candidate_index").distinct()
    return K.blend_lane(top, second_scores(spark, sf, base), "vlm", n=6)


@query("rk_04_blend_lane", sql("SELECT episode_id, candidate_index, b1 AS score, vlm AS vlm_score, 'why' || CASE WHEN vlm IS NULL THEN '' ELSE ' | vlm: seen' END AS reasoning, ord1 AS ord FROM o1",
                               "totals", extra=_LANE))
def rk4(spark, sf):
    return lane_one(spark, sf).select("episode_id", "candidate_index", "score", "vlm_score", "reasoning", F.col("ord").cast("bigint").alias("ord"))


_LANE2 = _LANE + """, o2 AS (SELECT *, CASE WHEN ord1 <= 3 THEN CAST(least(greatest(round(0.4 * b1 + 0.6 * ((candidate_index * 31) % 101)), 0), 100) AS BIGINT) ELSE b1 END AS b2 FROM o1),
   o3 AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY b2 DESC, ord1) AS ord2 FROM o2)"""


def lane_two(spark, sf):
    c = stage(cands(spark, sf), "candidates")
    one = lane_one(spark, sf, c)
    premium = c.select("episode_id", "candidate_index", ((F.col("candidate_index") * 31) % 101).alias("second"), F.lit("").alias("why"))
    return K.blend_lane(one, premium, "vlm_premium")


@query("rk_05_premium_lane", sql("SELECT episode_id, candidate_index, b2 AS score, CASE WHEN ord1 <= 3 THEN (candidate_index * 31) % 101 END AS vlm_premium_score, ord2 AS ord FROM o3",
                                 "totals", extra=_LANE2))
def rk5(spark, sf):
    return lane_two(spark, sf).select("episode_id", "candidate_index", "score", "vlm_premium_score", F.col("ord").cast("bigint").alias("ord"))


@query("rk_06_finalize_clips", sql("""SELECT episode_id || '_clip_' || ord2 AS id, episode_id AS job_id, start_ms, end_ms, ord2 AS rank, b2::DOUBLE AS score,
   'hook ' || idx AS hook, trend_match, hook_type, 'generated' AS status FROM o3 WHERE ord2 <= 5""", "totals", extra=_LANE2))
def rk6(spark, sf):
    return K.finalize_clips(lane_two(spark, sf), 5).drop("reasoning")


_HISTORY = """lines AS (SELECT side, idx, line FROM (""" + HISTORY_LINES + """)),
   hist AS (SELECT chr(10) || '--- HISTORICAL PERFORMANCE DATA ---' || chr(10) || 'Measured results of earlier clips, for calibration.' || chr(10) || chr(10) ||
     'TOP PERFORMERS (highest CTR):' || chr(10) || string_agg(line, chr(10) ORDER BY idx) FILTER (side = 'best') || chr(10) || chr(10) ||
     'WORST PERFORMERS (lowest CTR):' || chr(10) || string_agg(line, chr(10) ORDER BY idx) FILTER (side = 'worst') || chr(10) || '--- END HISTORICAL DATA ---' || chr(10) AS h FROM lines),
   tl AS (SELECT string_agg('- ' || label || ' (score: ' || printf('%.0f', score) || ') [' || source || ']', chr(10) ORDER BY score DESC, source, topic_id) AS x FROM (
     SELECT * FROM trends t WHERE fetched_at = (SELECT max(fetched_at) FROM trends u WHERE u.source = t.source AND u.topic_id = t.topic_id)
     ORDER BY score DESC, source, topic_id LIMIT 20))"""


@query("rk_07_prompt_context", sql("""SELECT id AS episode_id, 'CURRENT TRENDS (boost candidates that align with these topics):' || chr(10) || x ||
   CASE WHEN n_name IS NULL THEN '' ELSE chr(10) || chr(10) || 'Show topic priors:' || chr(10) || '- topics of ' || n_name || chr(10) || '- more' END AS current_trends,
   h AS performance_history FROM jobs LEFT JOIN nation ON 'show_' || n_nationkey = show_slug, tl, hist""", "jobs", "trends", "stats", "stat_clips",
                                   extra=HISTORY_TOP + ", " + _HISTORY))
def rk7(spark, sf):
    episodes = t.jobs(spark, sf).select(F.col("id").alias("episode_id"), "show_slug")
    priors = t.read(spark, sf, "nation").select(F.concat(F.lit("show_"), "n_nationkey").alias("show_slug"),
                                                F.concat(F.lit(" topics of "), "n_name", F.lit(" \n\n more ")).alias("content"))
    history = R.history_text(R.performance_history(t.stat_clips(spark, sf), t.analytics(spark, sf)))
    return K.prompt_context(episodes, TR.recent_trends(t.trends(spark, sf), 20), priors, history)


# -- PST ----------------------------------------------------------------------------

@query("pst_01_plan_posts", sql("""SELECT c.id AS clip_id, p AS platform, CASE WHEN hook_type IS NULL OR trend_match IS NULL THEN 'skipped' ELSE 'dry_run' END AS status,
   CASE WHEN hook_type IS NULL THEN '9x16 variant missing' WHEN trend_match IS NULL THEN 'no social copy for this clip' END AS reason
   FROM clips c, (VALUES ('youtube'), ('bluesky'), ('x')) v(p)""", "clips"))
def pst1(spark, sf):
    clips = t.clips(spark, sf).withColumnRenamed("id", "clip_id")
    return P.plan_posts(clips, renders(spark, sf), clips.filter(F.col("trend_match").isNotNull()), ["youtube", "bluesky", "x"], dry_run=True)


_TAGS = [["#clips", " #deep dive ", ""], [], ["##two", "one"], ["#x"]]


def copies(spark, sf):
    """Social copy made of each document's text, in its JSON form, parsed again."""
    d = t.read(spark, sf, "documents")
    tags = F.element_at(F.array(*[F.array(*[F.lit(x) for x in tag]).cast("array<string>") for tag in _TAGS]), (F.col("doc_id") % 4 + 1).cast("int"))
    block = lambda name: F.struct(F.col("text").alias(name), tags.alias("hashtags"))
    yt = F.struct(F.col("text").alias("title"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise("").alias("description"), tags.alias("hashtags"))
    empty = F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(" ").alias("caption"), tags.alias("hashtags"))
    json = F.to_json(F.struct(yt.alias("youtube_shorts"), empty.alias("tiktok"), block("caption").alias("instagram_reels"), block("text").alias("threads"),
                              block("post_text").alias("linkedin"), block("text").alias("x"), block("text").alias("bluesky")))
    return P.parse_copy(d.select(F.col("doc_id").alias("clip_id"), json.alias("social_copy_json")))


_PST2 = r"""WITH d AS (SELECT doc_id AS clip_id, doc_id % 2 = 0 AS has_tik, doc_id % 3 <> 0 AS has_desc, text AS raw, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b,
    (['#clips ##deep dive', '', '#two #one', '#x'])[doc_id % 4 + 1] AS h, (['#clips #deep dive #', '', '##two #one', '#x'])[doc_id % 4 + 1] AS p,
    ([['#clips', '#deep dive', '#'], [], ['##two', '#one'], ['#x']])[doc_id % 4 + 1] AS pl FROM documents),
  w AS (SELECT *, CASE WHEN h = '' THEN b WHEN b = '' THEN h ELSE b || chr(10) || chr(10) || h END AS bh,
    CASE WHEN p = '' THEN b WHEN b = '' THEN p ELSE b || chr(10) || chr(10) || p END AS bp,
    list_filter(pl, lambda x: NOT contains(b, x)) AS miss FROM d),
  v AS (SELECT *, CASE WHEN len(miss) = 0 THEN b WHEN b = '' THEN array_to_string(miss, ' ') ELSE b || chr(10) || chr(10) || array_to_string(miss, ' ') END AS bm,
    CASE WHEN has_tik THEN b ELSE '' END AS tk, CASE WHEN has_desc THEN b ELSE '' END AS ds,
    regexp_replace(raw || CASE WHEN has_desc AND raw <> '' THEN chr(10) || chr(10) || raw ELSE '' END, '^\s+|\s+$', '', 'g') AS yb FROM w),
  r AS (SELECT clip_id, raw, unnest(['x', 'linkedin', 'threads', 'tiktok', 'instagram_browser', 'bluesky_browser', 'youtube_browser', 'bluesky', 'instagram', 'youtube', 'ayrshare']) AS platform,
    unnest([CASE WHEN length(bh) > 280 THEN bh[1:279] || '…' ELSE bh END, bh, CASE WHEN length(bh) > 500 THEN bh[1:499] || '…' ELSE bh END,
      CASE WHEN h = '' THEN tk WHEN tk = '' THEN h ELSE tk || chr(10) || chr(10) || h END, bh, bh,
      CASE WHEN h = '' THEN yb WHEN yb = '' THEN h ELSE yb || chr(10) || chr(10) || h END,
      CASE WHEN length(bp) > 300 THEN bp[1:297] || '...' ELSE bp END, CASE WHEN length(bm) > 2200 THEN bm[1:2197] || '...' ELSE bm END,
      CASE WHEN contains(lower(ds), '#shorts') THEN ds WHEN ds = '' THEN '#Shorts' ELSE ds || chr(10) || '#Shorts' END,
      CASE WHEN b = '' THEN '' WHEN length(bm) > 2200 THEN bm[1:2197] || '...' ELSE bm END]) AS text FROM v)
  SELECT clip_id, platform, CASE WHEN platform = 'youtube' THEN CASE WHEN length(raw) > 100 THEN raw[1:100] ELSE raw END END AS title, text FROM r"""


@query("pst_02_compose_posts", _PST2)
def pst2(spark, sf):
    return P.compose_posts(copies(spark, sf), ["instagram"])


@query("pst_03_admit_by_quota", """SELECT event_id AS plan_id, row_number() OVER (PARTITION BY user_id % 5, CAST(ts AS DATE) ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) <= 6 AS admitted FROM events""")
def pst3(spark, sf):
    plan = t.read(spark, sf, "events").select(F.col("event_id").alias("plan_id"), (F.col("user_id") % 5).alias("account"), F.unix_seconds("ts").alias("planned_at"))
    return P.admit_by_quota(plan).select("plan_id", "admitted")


_VETO = """dir AS (SELECT doc_id AS message_id, doc_id * 7 % 997 AS episode_id, unnest(['clip_0' || (doc_id % 8), 'clip_2']) AS label FROM documents),
   dd AS (SELECT DISTINCT * FROM dir),
   one AS (SELECT job_id, rank, min(id) AS clip_id FROM clips GROUP BY ALL),
   n AS (SELECT d.*, o.clip_id, p.platform AS pf, p.status, p.external_id FROM dd d LEFT JOIN one o ON o.job_id = d.episode_id
     AND o.rank = CAST(split_part(label, '_', 2) AS BIGINT) LEFT JOIN clip_posts p ON p.clip_id = o.clip_id AND p.status <> 'failed')"""


_OUTCOMES = """SELECT message_id, label, CASE WHEN clip_id IS NULL OR pf IS NULL THEN 'all' ELSE pf END AS platform, detail,
   detail IN ('already vetoed', 'to remove') AS success FROM (SELECT *, CASE WHEN clip_id IS NULL THEN 'clip ''' || label || ''' not found in database'
   WHEN pf IS NULL THEN 'no posts found for this clip' WHEN status = 'vetoed' THEN 'already vetoed' WHEN coalesce(external_id, '') = '' THEN 'no external_id recorded'
   WHEN pf NOT IN ('youtube', 'bluesky', 'threads') THEN 'platform not configured' ELSE 'to remove' END AS detail FROM n)"""


@query("pst_04_resolve_vetoes", sql(_OUTCOMES, "clips", "clip_posts", extra=_VETO))
def pst4(spark, sf):
    return vetoes(spark, sf)


def vetoes(spark, sf):
    d = F.col("doc_id")
    body = F.concat(F.lit("veto: clip_0"), d % 8, F.lit(" and veto: CLIP_2 "), "text")
    from ..sources.messages import extract_directives
    m = extract_directives(t.read(spark, sf, "documents").select("doc_id", body.alias("body")))
    dirs = m.select(d.alias("message_id"), (d * 7 % 997).alias("episode_id"), F.explode("labels").alias("label"))
    clips = t.clips(spark, sf).groupBy(F.col("job_id").alias("episode_id"), "rank").agg(F.min("id").alias("clip_id"))
    posts = t.clip_posts(spark, sf).filter(F.col("status") != "failed")
    return P.resolve_vetoes(dirs, clips, posts, ["youtube", "bluesky", "threads"])


@query("pst_04_veto_replies", sql("""SELECT message_id, 'Veto results:' || chr(10) || chr(10) || string_agg(block, '' ORDER BY block) AS text FROM (
   SELECT message_id, label || ':' || chr(10) || string_agg(line, '' ORDER BY line) || chr(10) AS block FROM (
     SELECT message_id, label, '  [' || CASE WHEN success THEN 'OK' ELSE 'FAIL' END || '] ' || platform || ': ' ||
       CASE WHEN detail = 'to remove' THEN 'removed' ELSE detail END || chr(10) AS line FROM outcomes) GROUP BY message_id, label) GROUP BY message_id""",
                                  "clips", "clip_posts", extra=_VETO + ", outcomes AS (" + _OUTCOMES + ")"))
def pst4b(spark, sf):
    return P.veto_confirmation(vetoes(spark, sf))

