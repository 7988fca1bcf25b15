"""SRC-1..12 and SNK-1..5. Logs, feeds and answers are spelled out from the given tables,
so that the parsed rows can be checked against the numbers they were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..sinks import tables as S
from ..session import shared_dir
from ..sources import feeds, logs, messages
from . import tables as t
from .catalog import query
from .tables import sql

LETTERS = "abcdefghijklmnop"


def pick(options, col):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (col + 1).cast("int"))


# -- SRC-1 --------------------------------------------------------------------------

@query("src_01_transcripts", r"""WITH c AS (SELECT conv_id AS episode_id, turn AS chunk_idx, turn * 60000 AS o, text,
     CASE WHEN (conv_id + turn) % 5 IN (1, 2, 3) OR (conv_id + turn) % 15 = 4 THEN [] ELSE regexp_extract_all(text, '[^ \t\n\f\r]+') END AS w,
     (conv_id + turn) % 5 AS m FROM conversations),
   x AS (SELECT episode_id, chunk_idx, o, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS pos FROM c)
   SELECT episode_id, chunk_idx, 'w' AS kind, CAST(pos AS BIGINT) AS pos, text, CAST(o + pos * 500 AS BIGINT) AS start_ms,
     CAST(o + pos * 500 + 250 AS BIGINT) AS end_ms FROM x
   UNION ALL SELECT episode_id, chunk_idx, 's', 0, CASE WHEN (episode_id + chunk_idx) % 15 = 4
     THEN array_to_string(regexp_extract_all(text, '\S+'), ' ') ELSE text END, o, o + 60000 FROM c WHERE m <> 3 AND NOT regexp_full_match(text, '\s*')""")
def src1(spark, sf):
    c = t.read(spark, sf, "conversations")
    toks = F.regexp_extract_all("text", F.lit(t.TOKEN), F.lit(1))
    words = F.transform(toks, lambda w, i: F.struct(w.alias("word"), (i * 0.5).alias("start"), (i * 0.5 + 0.25).alias("end")))
    seg = F.array(F.struct(F.lit(7).alias("id"), F.lit(0.0).alias("start"), F.lit(60.0).alias("end"), F.col("text").alias("text")))
    m = (F.col("conv_id") + F.col("turn")) % 5
    full = F.to_json(F.struct("text", seg.alias("segments"), words.alias("words"), F.lit("x").alias("extra")))
    bare = F.to_json(F.struct("text", seg.alias("segments")))
    null = F.to_json(F.struct("text", seg.alias("segments"), F.lit(None).cast("array<string>").alias("words")), {"ignoreNullFields": "false"})
    textual = F.to_json(F.struct("text"))   # no segments: one for the minute is made
    json = F.when((F.col("conv_id") + F.col("turn")) % 15 == 4, textual).when(m == 1, bare).when(m == 2, null).when(m == 3, "{not json").otherwise(full)
    rows = c.select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("chunk_idx"),
                    (F.col("turn") * 60_000).alias("offset_ms"), json.alias("json"))
    w, s = feeds.read_transcripts(rows)
    cols = ["episode_id", "chunk_idx", "kind", "pos", "text", "start_ms", "end_ms"]
    return (w.withColumn("kind", F.lit("w")).select(*cols)
            .unionByName(s.withColumn("kind", F.lit("s")).select(*cols)))


# -- SRC-2..5 -----------------------------------------------------------------------

def log_of(spark, sf, line):
    ev = t.events(spark, sf)
    return ev.select("episode_id", F.floor(F.col("event_id") / 500).alias("part"), F.col("event_id").alias("ord"),
                     line.alias("line")).filter(F.col("line").isNotNull())


def secs(col):
    return F.format_string("%.2f", col)


def exact(ms):
    """Whole milliseconds written as seconds."""
    ms = ms.cast("bigint")
    return F.concat(F.floor(ms / 1000), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


_SILENCE_SQL = sql("""SELECT episode_id, CAST(round(greatest(s, 0) * 1000) AS BIGINT) AS start_ms, CAST(round(e * 1000) AS BIGINT) AS end_ms
   FROM (SELECT *, lag(CASE WHEN k = 's' THEN v END) OVER (PARTITION BY episode_id ORDER BY event_id) AS s, v AS e FROM (
     SELECT episode_id, event_id, CASE WHEN event_type = 'view' THEN 's' ELSE 'e' END AS k,
       CASE WHEN event_type = 'view' THEN round(value - 5, 2) ELSE round(value, 2) END AS v
     FROM ev WHERE event_type IN ('view', 'click'))) WHERE k = 'e' AND s IS NOT NULL AND e > greatest(s, 0)""", "ev")


def silence_lines(spark, sf):
    kind = F.col("event_type")
    line = (F.when(kind == "view", F.concat(F.lit("[det @ 0x1] silence_start: "), secs(F.round(F.col("value") - 5, 2))))
            .when(kind == "click", F.concat(F.lit("[det @ 0x1] silence_end: "), secs(F.col("value")), F.lit(" | silence_duration: 9.9")))
            .otherwise("frame= 12 fps=0.0"))
    return log_of(spark, sf, line)


@query("src_02_silence_log", _SILENCE_SQL)
def src2(spark, sf):
    return logs.read_silence_log(silence_lines(spark, sf))


def write_logs(lines, path):
    """One file per recording, named by it, as the tools leave them."""
    def write(batches):
        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        out, name, n = None, None, 0
        for pdf in batches:
            for episode, line in zip(pdf["episode_id"], pdf["line"]):
                if episode != name:
                    if out is not None:
                        out.close()
                    name, n = episode, n + 1
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{episode}.log")
                out.write(line.encode() + b"\n")
        if out is not None:
            out.close()
        yield pd.DataFrame({"n": [n]})

    lines.repartition("episode_id").sortWithinPartitions("episode_id", "ord").select("episode_id", "line").mapInPandas(write, "n long").collect()


@query("src_02_silence_files", _SILENCE_SQL)
def src2_files(spark, sf):
    """The same lines from files."""
    path = shared_dir(spark, "logs")
    write_logs(silence_lines(spark, sf), path if ":" in path else f"file://{path}")
    read = logs.read_silence_log(logs.read_log_lines(spark, path))
    return read.select(F.col("episode_id").cast("bigint").alias("episode_id"), "start_ms", "end_ms")


@query("src_03_shot_log", sql("""SELECT episode_id, t AS t_ms FROM walk WHERE keep""", "ev", recursive=True, extra="""
   d AS (SELECT episode_id, t, row_number() OVER (PARTITION BY episode_id ORDER BY t) AS i FROM (
     SELECT DISTINCT episode_id, CAST(floor(value * 50) AS BIGINT) AS t FROM ev)),
   walk AS (SELECT episode_id, t, i, t AS last, true AS keep FROM d WHERE i = 1
     UNION ALL SELECT d.episode_id, d.t, d.i, CASE WHEN d.t - w.last >= 10 THEN d.t ELSE w.last END, d.t - w.last >= 10
       FROM walk w JOIN d ON d.episode_id = w.episode_id AND d.i = w.i + 1)"""))
def src3(spark, sf):
    line = F.concat(F.lit("[info] n: 0 pts: 9 pts_time:"), exact(F.floor(F.col("value") * 50)), F.lit(" fmt:x"))
    return logs.read_shot_log(log_of(spark, sf, line))


@query("src_04_level_log", sql("""SELECT episode_id, t_ms, db AS rms_db FROM (
   SELECT episode_id, f, CAST(max(CASE WHEN event_type = 'view' THEN greatest(round(round(value - 3, 2) * 1000), 0) END) AS BIGINT) AS t_ms,
     coalesce(arg_max(CASE WHEN event_type = 'click' THEN -round(value, 2) END, CASE WHEN event_type = 'click' THEN event_id END),
              arg_min(CASE WHEN event_type = 'error' THEN -round(value, 2) END, CASE WHEN event_type = 'error' THEN event_id END)) AS db
   FROM (SELECT *, count(*) FILTER (event_type = 'view') OVER (PARTITION BY episode_id ORDER BY event_id) AS f FROM ev)
   WHERE f > 0 GROUP BY ALL) WHERE db IS NOT NULL""", "ev"))
def src4(spark, sf):
    k = F.col("event_type")
    line = (F.when(k == "view", F.concat(F.lit("frame:1    pts:9   pts_time:"), secs(F.round(F.col("value") - 3, 2))))
            .when(k == "click", F.concat(F.lit("lavfi.astats.Overall.RMS_level=-"), secs(F.col("value"))))
            .when(k == "error", F.concat(F.lit("lavfi.astats.1.RMS_level=-"), secs(F.col("value")))).otherwise("noise"))
    return logs.read_level_log(log_of(spark, sf, line))


@query("src_05_pitch_log", sql("""SELECT episode_id, t_ms,
   greatest(round(value - 20, 2), 0) AS pitch_hz FROM ev WHERE event_type <> 'error'""", "ev"))
def src5(spark, sf):
    line = F.when(F.col("event_type") == "error", "nan 5").otherwise(F.concat(
        F.lit(" "), exact(F.col("t_ms")), F.lit("\t"), secs(F.round(F.col("value") - 20, 2))))
    return logs.read_pitch_log(log_of(spark, sf, line))


# -- SRC-6 --------------------------------------------------------------------------

@query("src_06_trend_feeds", sql("""SELECT 'gdelt' AS source, episode_id AS feed_id, CASE WHEN event_id % 4 = 0 THEN 'gdelt_' || i ELSE 'u' || event_id END AS topic_id,
     'T' || event_id AS label, round(1 - i / 30.0, 6) AS score FROM r
   UNION ALL SELECT 'reddit', episode_id, 'reddit_' || event_id, 'r/' || event_type || ': T' || event_id,
     round(greatest(least(s::DOUBLE / greatest(max(s) OVER (PARTITION BY episode_id), 1), 1), 0), 6) FROM r
   UNION ALL SELECT 'google', episode_id, 'google_q' || event_id, 'q' || event_id, round(1 - least(i / 20.0, 0.95), 6) FROM r
   UNION ALL SELECT 'google', episode_id, 'google_story_' || i, CASE WHEN event_id % 3 = 1 THEN 'A, B' ELSE 'S' || event_id END,
     round(1 - least(i / 20.0, 0.95), 6) FROM r WHERE event_id % 3 <> 2""", "ev", extra="""
   r AS (SELECT episode_id, event_id, event_type, CAST(trunc(value) AS BIGINT) - 10 AS s,
     row_number() OVER (PARTITION BY episode_id, event_id // 2000 ORDER BY event_id) - 1 AS i FROM ev)""").replace(
    "PARTITION BY episode_id)", "PARTITION BY episode_id, event_id // 2000)").replace("episode_id AS feed_id", "episode_id || '_' || (event_id // 2000) AS feed_id")
    .replace("'reddit', episode_id,", "'reddit', episode_id || '_' || (event_id // 2000),").replace("'google', episode_id,", "'google', episode_id || '_' || (event_id // 2000),"))
def src6(spark, sf):
    ev = t.events(spark, sf)
    k = F.col
    item = F.struct(
        k("event_id").alias("o"), F.when(k("event_id") % 4 != 0, F.concat(F.lit("u"), k("event_id"))).alias("url"),
        F.concat(F.lit("T"), k("event_id")).alias("title"), k("event_id").cast("string").alias("id"), k("event_type").alias("sub"),
        (k("value").cast("bigint") - 10).alias("score"))
    feed = ev.groupBy(F.concat_ws("_", "episode_id", F.floor(k("event_id") / 2000)).alias("feed_id")).agg(
        F.array_sort(F.collect_list(item)).alias("x"))
    tr = F.transform
    news = F.to_json(F.struct(tr("x", lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title"))).alias("articles")))
    forum = F.to_json(F.struct(F.struct(tr("x", lambda r: F.struct(F.struct(
        r["id"].alias("id"), r["sub"].alias("subreddit"), r["title"].alias("title"), r["score"].alias("score")).alias("data"))).alias("children")).alias("data")))
    day = F.array(F.struct(tr("x", lambda r: F.struct(F.struct(F.concat(F.lit("q"), r["id"]).alias("query")).alias("title"))).alias("trendingSearches")))
    story = tr("x", lambda r: F.struct(
        F.when(r["o"] % 3 == 0, F.concat(F.lit("S"), r["id"])).otherwise("").alias("title"),
        F.when(r["o"] % 3 == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>")).alias("entityNames")))
    search = F.concat(F.lit(")]}'\n"), F.to_json(F.struct(F.struct(day.alias("trendingSearchesDays")).alias("default"),
                                                        F.struct(story.alias("trendingStories")).alias("storySummaries"))))
    out = None
    for kind, body in (("news", news), ("forum", forum), ("searches", search)):
        part = feeds.read_trend_feed(feed.select("feed_id", body.alias("body")), kind)
        out = part if out is None else out.unionByName(part)
    return out.select("source", "feed_id", "topic_id", "label", F.round("score", 6).alias("score"))


@query("src_08_post_stats", sql("""SELECT event_id AS clip_id, CASE WHEN event_id % 2 = 0 THEN 'video' ELSE 'thread' END AS platform,
   CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN v END AS views, CASE WHEN event_id % 3 <> 0 THEN event_id % 50 END AS likes,
   CASE WHEN event_id % 2 = 1 AND event_id % 3 <> 0 THEN event_id % 7 END AS reposts,
   CASE WHEN event_id % 3 <> 0 AND (event_id % 2 = 1 OR event_id % 5 <> 0) THEN event_id % 9 END AS replies
   FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS v FROM ev)""", "ev"))
def src8(spark, sf):
    k = F.col
    ev = t.events(spark, sf).select(k("event_id").alias("clip_id"), F.lit(0).alias("fetched_at"), F.floor(k("value") * 100).alias("v"))
    e = k("clip_id")
    reply = F.when(e % 5 == 0, "n/a").otherwise((e % 9).cast("string"))
    video = F.when(e % 3 == 0, '{"items":[]}').otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(
        k("v").cast("string").alias("viewCount"), (e % 50).cast("string").alias("likeCount"), reply.alias("commentCount")).alias("statistics"))).alias("items"))))
    thread = F.when(e % 3 == 0, "{}").otherwise(F.to_json(F.struct(F.struct(F.struct(
        (e % 50).alias("likeCount"), (e % 7).alias("repostCount"), (e % 9).alias("replyCount")).alias("post")).alias("thread"))))
    a = feeds.read_post_stats(ev.filter(e % 2 == 0).select("clip_id", F.lit("video").alias("platform"), "fetched_at", video.alias("body")), "video")
    b = feeds.read_post_stats(ev.filter(e % 2 == 1).select("clip_id", F.lit("thread").alias("platform"), "fetched_at", thread.alias("body")), "thread")
    return a.unionByName(b).select("clip_id", "platform", "views", "likes", "reposts", "replies")


@query("src_09_seen_ids", """SELECT DISTINCT CAST(l_partkey * 40 AS VARCHAR) AS id, 'done' AS status, 1705708800::BIGINT AS created_at,
   1705708800::BIGINT AS updated_at FROM lineitem WHERE l_partkey * 40 NOT IN (SELECT o_orderkey FROM orders)""")
def src9(spark, sf):
    lines = t.read(spark, sf, "lineitem").select(F.concat(F.lit(" \t"), (F.col("l_partkey") * 40).cast("string"), F.lit("  ")).alias("line"))
    return logs.import_seen_ids(lines, t.jobs(spark, sf), 1_705_708_800)


@query("src_10_resolve_params", """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS m, o_custkey AS c FROM orders),
  p AS (SELECT id, m, c, CASE WHEN m IN (0, 4) THEN greatest(c % 9, 1) ELSE 5 END AS clip_top_k,
    CASE WHEN m = 0 THEN greatest(c % 20, 5)::DOUBLE ELSE 10 END AS lo,
    CASE WHEN m = 0 THEN least(c % 70, 51) ELSE 18 END AS clip_video_crf,
    CASE WHEN m = 0 THEN least(greatest(c % 700, 32), 512) ELSE 192 END AS clip_audio_bitrate_kbps,
    CASE WHEN m = 0 AND c % 5 > 0 THEN (c % 5)::DOUBLE ELSE 15 END AS clip_stride_secs,
    CASE WHEN m = 0 AND c % 2 = 0 THEN 'slow' ELSE 'medium' END AS clip_video_preset,
    CASE WHEN m = 4 THEN true ELSE false END AS asd_enabled FROM o),
  q AS (SELECT *, CASE WHEN m = 0 THEN greatest((c % 25)::DOUBLE, lo + 1) ELSE 30 END AS hi FROM p)
  SELECT id, clip_top_k, lo AS clip_min_secs, hi AS clip_max_secs, CASE WHEN m = 0 THEN least(greatest((c % 40)::DOUBLE, lo), hi) ELSE 20 END AS clip_target_secs,
    clip_video_crf, clip_audio_bitrate_kbps, clip_stride_secs, clip_video_preset, asd_enabled FROM q""")
def src10(spark, sf):
    k = F.col
    c, m = k("o_custkey"), k("o_orderkey") % 6
    full = F.to_json(F.struct(
        (c % 9).alias("clip_top_k"), (c % 20).cast("double").alias("clip_min_secs"), (c % 25).alias("clip_max_secs"),
        (c % 40).alias("clip_target_secs"), (c % 70).alias("clip_video_crf"), (c % 700).alias("clip_audio_bitrate_kbps"),
        (c % 5).alias("clip_stride_secs"), F.when(c % 2 == 0, "slow").otherwise("  ").alias("clip_video_preset")))
    wrong = F.lit('{"clip_top_k":"7","clip_min_secs":true,"clip_video_crf":1.5,"asd_enabled":1,"clip_video_preset":9}')
    json = (F.when(m == 0, full).when(m == 1, wrong).when(m == 2, "{broken").when(m == 3, "")
            .when(m == 4, F.to_json(F.struct((c % 9).alias("clip_top_k"), F.lit(True).alias("asd_enabled")))))
    jobs = t.read(spark, sf, "orders").select(k("o_orderkey").alias("id"), json.alias("config_json"))
    out = feeds.resolve_params(jobs)
    return out.select("id", F.col("clip_top_k").cast("bigint").alias("clip_top_k"), "clip_min_secs", "clip_max_secs", "clip_target_secs",
                      F.col("clip_video_crf").cast("bigint").alias("clip_video_crf"),
                      F.col("clip_audio_bitrate_kbps").cast("bigint").alias("clip_audio_bitrate_kbps"),
                      "clip_stride_secs", "clip_video_preset", "asd_enabled")


# Ids and labels are taken from the texts, so that a row can't be right without its text.
@query("src_11_link_ids", """SELECT doc_id, CASE doc_id % 5
   WHEN 0 THEN h WHEN 1 THEN 'B-' || h || ',' || h WHEN 2 THEN h || '_x' WHEN 3 THEN '' ELSE h || 'q,' || h || 'z' END AS ids
   FROM (SELECT doc_id, md5(text) AS h FROM documents)""")
def src11(spark, sf):
    d, h = F.col("doc_id"), F.md5("text")
    g = "https://drive.google.com"
    body = (F.when(d % 5 == 0, F.concat(F.lit(f"see {g}/file/d/"), h, F.lit(f"/view and {g}/file/d/"), h))
            .when(d % 5 == 1, F.concat(F.lit(f"{g}/open?id="), h, F.lit(f" {g}/drive/u/0/file/d/B-"), h))
            .when(d % 5 == 2, F.concat(F.lit("https://www.google.com/url?sa=D&amp;q=https%3A%2F%2Fdrive.google.com%2Ffile%2Fd%2F"), h, F.lit("_x%2Fview&amp;ust=1")))
            .when(d % 5 == 3, "https://drive.google.com/open?id=short")
            .otherwise(F.concat(F.lit(f"{g}/drive/folders/"), h, F.lit("q x?a=1&id="), h, F.lit("z"))))
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = t.read(spark, sf, "documents").select("doc_id", F.concat(F.substring("text", F.lit(1), half), F.lit("\n"), body, F.lit("\n"), F.substring("text", half + 1, F.char_length("text"))).alias("body"))
    return messages.extract_link_ids(rows).select("doc_id", F.array_join("link_ids", ",").alias("ids"))


@query("src_12_directives", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'clip_' || n WHEN 1 THEN 'clip_' || n || '1,clip_' || n || '2' ELSE '' END AS labels
   FROM (SELECT doc_id, length(text) AS n FROM documents)""")
def src12(spark, sf):
    d, n = F.col("doc_id"), F.char_length("text")
    lead = (F.when(d % 3 == 0, F.concat(F.lit("VETO:Clip_"), n))
            .when(d % 3 == 1, F.concat(F.lit("veto: clip_"), n, F.lit("2, veto:  CLIP_"), n, F.lit("1 veto: clip_"), n, F.lit("2")))
            .otherwise("noveto: clip_1"))
    half = F.floor(n / 2).cast("int")
    rows = t.read(spark, sf, "documents").select("doc_id", F.concat(F.substring("text", F.lit(1), half), F.lit("\n"), lead, F.lit(" \n"), F.substring("text", half + 1, n)).alias("body"))
    return messages.extract_directives(rows).select("doc_id", F.array_join("labels", ",").alias("labels"))


# -- SNK ----------------------------------------------------------------------------

@query("snk_01_upsert", sql("""SELECT id, coalesce(s, CASE WHEN n IS NULL THEN status END) AS status, CASE WHEN n IS NULL THEN cost_cents END AS cost_cents
   FROM jobs LEFT JOIN (SELECT l_orderkey AS k, arg_max(l_returnflag || l_linestatus, CAST(epoch(l_shipdate) AS BIGINT) * 10000000 + l_partkey) AS s,
   count(*) AS n FROM lineitem GROUP BY ALL) ON k = id""", "jobs"))
def snk1(spark, sf):
    target = t.jobs(spark, sf).select("id", "status", "cost_cents")
    ups = t.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("status"),
        (F.unix_seconds("l_shipdate") * 10_000_000 + F.col("l_partkey")).alias("v"))
    return S.upsert(target, ups, ["id"], "v")


def renders(spark, sf):
    c = t.clips(spark, sf).filter(F.col("hook_type").isNotNull())
    return c.select(F.col("id").alias("clip_id"), F.explode(F.array(F.lit("9x16"), F.lit("1x1"))).alias("variant"), "end_ms", "start_ms", "job_id").select(
        "clip_id", "variant", F.concat(F.lit("/work/clipper/"), "job_id", F.lit("/"), "clip_id", F.lit("_"), "variant", F.lit(".mp4")).alias("path"),
        F.when(F.col("variant") == "1x1", F.concat(F.lit("https://cdn/"), "clip_id")).alias("url"),
        ((F.col("end_ms") - F.col("start_ms")) * 100).alias("bytes"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        F.when(F.col("variant") == "1x1", 1080).otherwise(608).cast("bigint").alias("width"), F.lit(1080).cast("bigint").alias("height"), "job_id")


def ranked_clips(spark, sf):
    none = F.lit(None)
    return t.clips(spark, sf).select(
        F.col("job_id").alias("episode_id"), F.col("id").alias("clip_id"), "rank", "score", "start_ms", "end_ms", "hook", "hook_type",
        F.col("score").alias("llm_score"), none.cast("bigint").alias("vlm_score"), none.cast("string").alias("vlm_reasoning"),
        none.cast("bigint").alias("vlm_premium_score"), none.cast("string").alias("vlm_premium_reasoning"),
        F.concat(F.lit("because "), "score").alias("reasoning"),
        F.when(F.col("rank") % 2 == 1, F.concat(F.lit("/work/clipper/"), "job_id", F.lit("/"), "id", F.lit(".jpg"))).alias("cover_path"))


def sent_posts(spark, sf):
    return t.clip_posts(spark, sf).withColumn("external_url", F.concat(F.lit("https://"), "platform", F.lit("/"), "external_id")).withColumn(
        "error", F.when(F.col("status") == "failed", "oops"))


def social_blocks(spark, sf):
    """A social block for every clip whose score divides by three."""
    c = t.clips(spark, sf).filter(F.col("score") % 3 == 0)
    tags, rank = F.array(F.concat(F.lit("#r"), "rank"), F.lit("#all")), F.col("rank").cast("string")
    texts = {"title": F.concat(F.lit("Title "), rank), "description": F.concat(F.lit("one "), rank, F.lit("\ntwo")), "pinned_comment": F.lit("")}
    block = lambda p: F.struct(*[texts.get(f, F.concat(F.lit(f"{p} "), rank)).alias(f) for f in S.SOCIAL_TEXTS[p]], tags.alias("hashtags")).alias(p)
    social = F.struct(*[block(p) for p in S.SOCIAL_TEXTS], F.coalesce(F.concat(F.lit("over "), "hook"), F.lit("")).alias("overlay_hook"), F.lit("llm").alias("hook_source"))
    return c.select(F.col("id").alias("clip_id"), social.alias("social"), "job_id")


def clip_manifests(spark, sf):
    """Every child names the job of its clip as its episode."""
    of = lambda df: df.withColumnRenamed("job_id", "episode_id")
    return S.episode_manifests(ranked_clips(spark, sf), of(renders(spark, sf)), of(sent_posts(spark, sf)), of(job_words(spark, sf)),
                               job_episodes(spark, sf), job_costs(spark, sf), of(social_blocks(spark, sf)))


def all_manifests(spark, path):
    """The manifests of all jobs, none of them moved to be chosen."""
    return S.read_manifests(spark, path).withColumn("episode_id", F.col("episode_id").cast("bigint"))


def job_episodes(spark, sf):
    return t.jobs(spark, sf).select(F.col("id").alias("episode_id"), F.concat(F.lit("ep"), "id", F.lit(".mp4")).alias("media_name"),
                                    F.col("cost_cents").alias("total_ms"), F.concat(F.lit("/work/clipper/"), "id").alias("clips_dir"))


def job_costs(spark, sf):
    return R.cost_by_category(t.usage(spark, sf)).withColumnRenamed("job_id", "episode_id")


def job_words(spark, sf):
    """Caption words of each clip: two from its hook."""
    return t.clips(spark, sf).select(F.col("id").alias("clip_id"), "job_id", F.posexplode(F.array(
        F.struct(F.lit("hook").alias("text"), F.lit(0).alias("s")), F.struct(F.coalesce("hook", F.lit("none")).alias("text"), F.lit(400).alias("s")))).alias("pos", "w")
    ).select("clip_id", "job_id", "pos", "w.text", F.col("w.s").alias("start_ms"), (F.col("w.s") + 300).alias("end_ms"))


@query("snk_02_manifests", sql("""SELECT j.id AS episode_id, 4::BIGINT AS schema_version, count(c.id) AS n_clips, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS n_posts,
   count(c.hook_type) * 2 AS n_variants, count(c.id) * 2 AS n_words, count(c.id) - count(c.hook_type) AS bare_clips, count(c.id) - count(c.hook) AS null_hooks,
   CAST(coalesce(sum(c.end_ms - c.start_ms), 0) AS BIGINT) AS length_ms,
   string_agg(c.hook, '|' ORDER BY c.rank, c.id) AS hooks, (SELECT nullif(count(*), 0) FROM usage u WHERE u.job_id = j.id) AS total_calls
   FROM jobs j LEFT JOIN clips c ON c.job_id = j.id LEFT JOIN (SELECT clip_id, count(*) AS n FROM clip_posts GROUP BY ALL) p ON p.clip_id = c.id
   GROUP BY j.id""", "clips", "clip_posts", "usage", "jobs"))
def snk2(spark, sf):
    """Read back from the documents; lists that are empty and values that are null must be written."""
    m = clip_manifests(spark, sf)
    back = F.from_json("manifest", "schema_version bigint, clips array<struct<hook:string, start_secs:double, end_secs:double, posts:array<struct<platform:string>>, "
                       "variants:array<struct<label:string>>, words:array<struct<text:string>>>>, cost struct<total_calls:bigint>")
    total = lambda of: F.aggregate("m.clips", F.lit(0).cast("bigint"), lambda a, c: a + of(c))
    said = F.filter("m.clips.hook", lambda h: h.isNotNull())
    return m.select("episode_id", "manifest", back.alias("m")).select(
        "episode_id", "m.schema_version", F.size("m.clips").cast("bigint").alias("n_clips"), total(lambda c: F.size(c["posts"])).alias("n_posts"),
        total(lambda c: F.size(c["variants"])).alias("n_variants"), total(lambda c: F.size(c["words"])).alias("n_words"),
        F.regexp_count("manifest", F.lit('"variants":\\[\\]')).cast("bigint").alias("bare_clips"),
        F.regexp_count("manifest", F.lit('"hook":null')).cast("bigint").alias("null_hooks"),
        total(lambda c: F.round((c["end_secs"] - c["start_secs"]) * 1000).cast("bigint")).alias("length_ms"),
        F.when(F.size(said) > 0, F.array_join(said, "|")).alias("hooks"), F.col("m.cost.total_calls").alias("total_calls"))


_CLIP_SQL = """c AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY rank, id) - 1 AS pos, score % 3 = 0 AS social FROM clips),
   v AS (SELECT id AS clip_id, string_agg(v || ' ' || id || '_' || v || '.mp4 /work/clipper/' || job_id || '/' || id || '_' || v || '.mp4 ' || w || ' 1080 ' || (end_ms - start_ms) * 100, ';' ORDER BY v) AS f
     FROM clips, (VALUES ('1x1', 1080), ('9x16', 608)) x(v, w) WHERE hook_type IS NOT NULL GROUP BY ALL),
   p AS (SELECT clip_id, string_agg(platform || ' ' || status || ' ' || coalesce(external_id, '-') || ' ' || coalesce('https://' || platform || '/' || external_id, '-') || ' ' ||
     coalesce(posted_at::VARCHAR, '-') || ' ' || CASE WHEN status = 'failed' THEN 'oops' ELSE '-' END, ';' ORDER BY platform) AS f FROM clip_posts GROUP BY ALL)"""


@query("snk_02_manifest_clips", sql("""SELECT job_id AS episode_id, pos::INT AS pos, 4::BIGINT AS schema_version, '/work/clipper/' || job_id AS clips_dir, rank, score,
     score AS blended, score AS llm, NULL::BIGINT AS vlm, NULL::VARCHAR AS vlm_reasoning, round(start_ms / 1000, 3) AS start_secs, round(end_ms / 1000, 3) AS end_secs,
     round(greatest(end_ms - start_ms, 0) / 1000, 3) AS duration_secs, printf('%02d:%02d-%02d:%02d', start_ms // 60000, start_ms // 1000 % 60, end_ms // 60000, end_ms // 1000 % 60) AS time_range_mmss,
     hook, CASE WHEN social AND hook IS NOT NULL THEN 'over ' || hook ELSE '' END AS overlay_hook, CASE WHEN social THEN 'llm' ELSE '' END AS hook_source, 'because ' || score AS reasoning, hook_type,
     coalesce(v.f, '') AS variants, CASE WHEN rank % 2 = 1 THEN id || '.jpg' END AS cover_file, CASE WHEN rank % 2 = 1 THEN '/work/clipper/' || job_id || '/' || id || '.jpg' END AS cover_path,
     CASE WHEN social THEN 'Title ' || rank || '|one ' || rank || chr(10) || 'two|#r' || rank || ' #all|linkedin ' || rank END AS copy, coalesce(p.f, '') AS posts,
     'hook 0.0 0.3;' || coalesce(hook, 'none') || ' 0.4 0.7' AS words
   FROM c LEFT JOIN v ON v.clip_id = id LEFT JOIN p ON p.clip_id = id""", "clips", "clip_posts", "jobs", extra=_CLIP_SQL))
def snk2_clips(spark, sf):
    """Every field of every clip, read back from the stored manifests."""
    path = f"{shared_dir(spark, 'manifests')}/table"
    S.write_manifests(clip_manifests(spark, sf), path)
    rows = all_manifests(spark, path)
    told = lambda xs, *fields: F.array_join(F.transform(xs, lambda x: F.concat_ws(" ", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields])), ";")
    y = F.col("social.youtube_shorts")
    copy = F.when(F.col("social").isNotNull(), F.concat_ws("|", y["title"], y["description"], F.array_join(y["hashtags"], " "), F.col("social.linkedin.post_text")))
    return rows.select("episode_id", "pos", "schema_version", "clips_dir", "rank", "score", "scores.blended", "scores.llm", "scores.vlm", "scores.vlm_reasoning",
                       *[F.round(c, 3).alias(c) for c in ("start_secs", "end_secs", "duration_secs")], "time_range_mmss", "hook", "overlay_hook", "hook_source", "reasoning", "hook_type",
                       told("variants", "label", "filename", "abs_path", "width", "height", "bytes").alias("variants"), F.col("cover_frame.filename").alias("cover_file"),
                       F.col("cover_frame.abs_path").alias("cover_path"), copy.alias("copy"),
                       told("posts", "platform", "status", "external_id", "external_url", "posted_at_unix", "error").alias("posts"), told("words", "text", "start_secs", "end_secs").alias("words"))


_MMSS = "printf('%02d:%02d', {0} // 60000, {0} // 1000 % 60)"
_RATES = """CASE model WHEN 'qwen/qwen3-32b' THEN 0.00029 WHEN 'whisper-large-v3-turbo' THEN 0.000444 WHEN 'whisper-large-v3' THEN 0.00123
   WHEN 'gpt-5-nano' THEN 0.002 WHEN 'gpt-4o-mini' THEN 0.0025 WHEN 'whisper-x' THEN 0.00123 WHEN 'bge-m3' THEN 0.0001 ELSE 0.001 END::DECIMAL(12, 9)"""
_RATES_OUT = """CASE model WHEN 'qwen/qwen3-32b' THEN 0.00059 WHEN 'gpt-5-nano' THEN 0.010 WHEN 'gpt-4o-mini' THEN 0.010 WHEN 'mystery' THEN 0.003 ELSE 0.0 END::DECIMAL(12, 9)"""
_TAGS = "'  Hashtags:     #r' || rank || ' #all' || chr(10)"
_COPY = (f"chr(10) || '  -- YouTube Shorts --' || chr(10) || '  Title:        Title ' || rank || chr(10) || '  Description:  one ' || rank || chr(10) || repeat(' ', 16) || 'two' || chr(10) || {_TAGS}"
         + "".join(f" || chr(10) || '  -- {h} --' || chr(10) || '  {(k + ':').ljust(14)}{p} ' || rank || chr(10) || {_TAGS}" for h, k, p in (
             ("TikTok", "Caption", "tiktok"), ("Instagram Reels", "Caption", "instagram_reels"), ("Threads", "Text", "threads"), ("LinkedIn", "Post", "linkedin"),
             ("X / Twitter", "Text", "x"), ("Bluesky", "Text", "bluesky"))))
_DIGEST = f"""files AS (SELECT id AS clip_id, string_agg('    [' || v || ']  ' || CASE v WHEN '1x1' THEN '1080' ELSE '608' END || 'x1080  ' || printf('%.1f', (end_ms - start_ms) * 100 / 1048576) || 'MB  /work/clipper/' || job_id || '/' || id || '_' || v || '.mp4' || chr(10), ''
     ORDER BY v) AS f FROM clips, (VALUES ('1x1'), ('9x16')) x(v) WHERE hook_type IS NOT NULL GROUP BY ALL),
   sent AS (SELECT clip_id, '  [' || CASE status WHEN 'posted' THEN 'POSTED ' WHEN 'failed' THEN 'FAILED ' ELSE status END || '] ' || rpad(platform, 10, ' ') || ' ' ||
     CASE WHEN status = 'posted' THEN coalesce('https://' || platform || '/' || external_id, '') WHEN status = 'failed' THEN 'oops' ELSE '' END || chr(10) AS p FROM clip_posts),
   blocks AS (SELECT job_id, count(*) AS n, string_agg(printf('## Clip %02d  score %d  ', rank, score) || {_MMSS.format('start_ms')} || '-' || {_MMSS.format('end_ms')} || '  (' || (end_ms - start_ms) // 1000 || 's)' || chr(10) ||
     CASE WHEN hook IS NULL THEN '' ELSE '  hook:    ' || hook || chr(10) END || '  why:     because ' || score || chr(10) || '  files:' || chr(10) || coalesce(f, '') ||
     CASE WHEN rank % 2 = 1 THEN '  cover:   /work/clipper/' || job_id || '/' || id || '.jpg' || chr(10) ELSE '' END ||
     CASE WHEN score % 3 = 0 THEN CASE WHEN hook IS NULL THEN '' ELSE '  overlay: over ' || hook || chr(10) END || {_COPY} ELSE '' END ||
     CASE WHEN p IS NULL THEN '' ELSE chr(10) || '  -- Posts --' || chr(10) || p END || chr(10) || repeat('-', 72) || chr(10), '' ORDER BY rank, id) AS b
     FROM clips LEFT JOIN files ON files.clip_id = id LEFT JOIN sent ON sent.clip_id = id GROUP BY job_id),
   cat AS (SELECT job_id, category, count(*) AS k, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o, CAST(sum(i * {_RATES} + o * {_RATES_OUT}) AS DOUBLE) / 10 AS c FROM (SELECT *,
     CASE category WHEN 'stt' THEN CAST(round(audio_s * 25) AS BIGINT) WHEN 'embeddings' THEN chars // 4 ELSE input_tokens END AS i,
     CASE WHEN category IN ('stt', 'embeddings') THEN 0 ELSE output_tokens END AS o FROM usage) GROUP BY job_id, category),
   cost AS (SELECT job_id, 'Cost breakdown:' || chr(10) || string_agg('  ' || rpad(CASE category WHEN 'stt' THEN 'STT' WHEN 'chat' THEN 'Chat/LLM' WHEN 'embeddings' THEN 'Embeddings' WHEN 'vlm' THEN 'VLM' ELSE 'VLM Premium' END, 14, ' ') ||
     printf(' %3d calls  %8d in  %8d out  $', k, i, o) || printf('%.4f', c / 100) || chr(10), '' ORDER BY list_position(['stt', 'chat', 'embeddings', 'vlm', 'vlm_premium'], category)) ||
     '  TOTAL         ' || printf(' %3d calls  total $', CAST(sum(k) AS BIGINT)) || printf('%.4f', CAST(sum(c::DECIMAL(24, 10)) AS DOUBLE) / 100) || chr(10) AS t FROM cat GROUP BY job_id)"""


@query("snk_03_digest", sql("""SELECT id AS episode_id, 'Episode: ep' || id || '.mp4' || chr(10) || 'Total duration: ' || CASE WHEN cost_cents >= 3600000
     THEN printf('%dh %02dm %02ds', cost_cents // 3600000, cost_cents // 60000 % 60, cost_cents // 1000 % 60) ELSE printf('%dm %02ds', cost_cents // 60000, cost_cents // 1000 % 60) END ||
   chr(10) || 'Clips produced: ' || coalesce(n, 0) || chr(10) || 'Clips directory: /work/clipper/' || id || chr(10) || CASE WHEN t IS NULL THEN '' ELSE chr(10) || t END || chr(10) || repeat('=', 72) || chr(10) || coalesce(b, '') || chr(10) || 'The files are at the paths above; choose from them and post.' || chr(10) AS digest
   FROM jobs LEFT JOIN blocks ON blocks.job_id = id LEFT JOIN cost ON cost.job_id = id""", "jobs", "clips", "clip_posts", "usage", extra=_DIGEST))
def snk3(spark, sf):
    of = lambda df: df.withColumnRenamed("job_id", "episode_id")
    return S.episode_digest(ranked_clips(spark, sf), of(renders(spark, sf)), of(sent_posts(spark, sf)), job_episodes(spark, sf), job_costs(spark, sf), of(social_blocks(spark, sf)))


@query("snk_04_prune_trends", sql("SELECT source, topic_id, fetched_at, score FROM trends WHERE fetched_at >= 1705708800 - 864000", "trends"))
def snk4(spark, sf):
    return S.prune_trends(t.trends(spark, sf), 1_705_708_800, 864_000).select("source", "topic_id", "fetched_at", "score")


@query("snk_04_append_trends", """SELECT event_type AS source, topic_id, arg_max(label, event_id) AS label, arg_max(score, event_id) AS score,
   1705708800::BIGINT AS fetched_at FROM (SELECT event_type, 'topic ' || user_id % 50 AS topic_id, 'label ' || event_id AS label, value AS score, event_id
   FROM events) GROUP BY 1, topic_id""")
def snk4_append(spark, sf):
    """Topics repeat in the batch; a batch written again replaces itself, and an old one is pruned."""
    path = f"{shared_dir(spark, 'trends')}/table"
    ev = t.read(spark, sf, "events")
    batch = ev.select(F.col("event_type").alias("source"), F.concat(F.lit("topic "), (F.col("user_id") % 50).cast("string")).alias("topic_id"),
                      F.concat(F.lit("label "), F.col("event_id").cast("string")).alias("label"), F.col("value").alias("score"), F.col("event_id").alias("pos"))
    for at in (1_705_000_000, 1_705_708_800, 1_705_708_800):
        S.append_trends(batch, path, at)
    S.prune_partitions(path, spark, 1_705_708_800, 86_400)
    return spark.read.parquet(path).select("source", "topic_id", "label", "score", "fetched_at")


@query("snk_05_bulk_action", sql("""SELECT id AS clip_id, 'clip' AS kind, CASE WHEN score >= 50 THEN 'posted' ELSE status END AS status FROM clips
   UNION ALL SELECT id, p, 'pending' FROM clips, (VALUES ('x:main'), ('threads')) v(p) WHERE score >= 50""", "clips"))
def snk5(spark, sf):
    clips = t.clips(spark, sf).withColumnRenamed("id", "clip_id")
    ids = clips.filter(F.col("score") >= 50).select("clip_id")
    changed, posts = S.bulk_action(clips, ids, "post", ["x:main", "threads", "x:main"])
    return changed.select("clip_id", F.lit("clip").alias("kind"), "status").unionByName(
        posts.select("clip_id", F.col("platform").alias("kind"), "status"))
