"""JSON answers of other systems to tables (SRC-1, SRC-6, SRC-7, SRC-8, SRC-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp_score, trim_ws
from ..operators.intervals import stitch_chunks, synth_segments, to_ms

# -- SRC-1 --------------------------------------------------------------------------

TRANSCRIPT = ("text string, segments array<struct<start:double,end:double,text:string>>, "
              "words array<struct<word:string,start:double,end:double>>")


def parse_transcripts(df: DataFrame, json: str = "json") -> DataFrame:
    """Adds text, segments and words; whatever is null or missing is empty or zero."""
    t = F.from_json(json, TRANSCRIPT)
    zero, blank = F.lit(0.0), F.lit("")
    out = df.withColumn("_t", t)
    words = F.transform(F.coalesce("_t.words", F.from_json(F.lit("[]"), "array<struct<word:string,start:double,end:double>>")),
                        lambda w: F.struct(F.coalesce(w["word"], blank).alias("word"),
                                           F.coalesce(w["start"], zero).alias("start"),
                                           F.coalesce(w["end"], zero).alias("end")))
    segs = F.transform(F.coalesce("_t.segments", F.from_json(F.lit("[]"), "array<struct<start:double,end:double,text:string>>")),
                       lambda s: F.struct(F.coalesce(s["start"], zero).alias("start"),
                                          F.coalesce(s["end"], zero).alias("end"),
                                          F.coalesce(s["text"], blank).alias("text")))
    return (out.withColumn("text", F.coalesce("_t.text", blank)).withColumn("words", words)
            .withColumn("segments", segs).drop("_t", json))


def read_transcripts(df: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(words, segments) on the episode timeline from chunk answers with episode_id,
    chunk_idx, offset_ms and the JSON text."""
    parsed = parse_transcripts(df, json)
    words, segments = stitch_chunks(parsed)
    # An answer with text but no segments gets one segment a minute; its length is the chunk's, or
    # else that of its last word, or a minute.
    silent = parsed.filter((F.size("segments") == 0) & (trim_ws("text") != ""))
    spoken = to_ms(F.array_max(F.transform("words", lambda w: w["end"])))
    length = F.coalesce(*([F.col("duration_ms")] if "duration_ms" in df.columns else []), spoken, F.lit(0)).cast("bigint")
    made = synth_segments(silent.withColumn("duration_ms", length)).withColumnRenamed("minute", "pos")
    return words, segments.unionByName(made.select(*segments.columns).filter(trim_ws("text") != ""))


# -- SRC-6 --------------------------------------------------------------------------

# How far down a feed the position score reaches, and its floor.
NEWS_SPAN, SEARCH_SPAN, SEARCH_DROP = 30.0, 20.0, 0.95


def _position_score(i: Column) -> Column:
    return F.lit(1.0) - F.least(i / SEARCH_SPAN, F.lit(SEARCH_DROP))


def read_trend_feed(df: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """(feed_id, source, topic_id, label, score) from feed answers (feed_id, body).

    ``kind`` is news, forum or searches; an unreadable answer gives no rows. One answer is
    one row of the feed, bounded by the service's page size.
    """
    src = df.select("feed_id", F.col(body).alias("_b"))
    if kind == "news":
        items = F.from_json("_b", "articles array<struct<url:string,title:string>>")["articles"]
        rows = src.select("feed_id", F.posexplode(items).alias("i", "a"))
        url = F.coalesce("a.url", F.lit(""))
        return rows.select("feed_id", F.lit("gdelt").alias("source"),
                           F.when(url == "", F.concat(F.lit("gdelt_"), F.col("i"))).otherwise(url).alias("topic_id"),
                           F.coalesce("a.title", F.lit("")).alias("label"),
                           (1.0 - F.col("i") / NEWS_SPAN).alias("score"))
    if kind == "forum":
        items = F.from_json("_b", "data struct<children:array<struct<data:struct<"
                                  "id:string,subreddit:string,title:string,score:bigint>>>>")["data"]["children"]
        rows = src.withColumn("_k", items).withColumn(
            "_max", F.greatest(F.coalesce(F.array_max(F.transform("_k", lambda c: c["data"]["score"])), F.lit(1)), F.lit(1)))
        rows = rows.select("feed_id", "_max", F.posexplode("_k").alias("i", "c")).select("feed_id", "_max", "c.data.*")
        return rows.select("feed_id", F.lit("reddit").alias("source"), F.concat(F.lit("reddit_"), "id").alias("topic_id"),
                           F.concat(F.lit("r/"), "subreddit", F.lit(": "), "title").alias("label"),
                           F.least(F.greatest(F.col("score") / F.col("_max"), F.lit(0.0)), F.lit(1.0)).alias("score"))
    if kind == "searches":
        plain = F.regexp_replace("_b", r"^\)\]\}'\s*", "")
        parsed = src.withColumn("_p", F.from_json(plain, (
            "default struct<trendingSearchesDays:array<struct<trendingSearches:array<struct<title:struct<query:string>>>>>>,"
            " storySummaries struct<trendingStories:array<struct<title:string,entityNames:array<string>>>>")))
        days = parsed.select("feed_id", F.explode("_p.default.trendingSearchesDays").alias("d"))
        daily = days.select("feed_id", F.posexplode("d.trendingSearches").alias("i", "s"))
        daily = daily.select("feed_id", F.lit("google").alias("source"),
                             F.concat(F.lit("google_"), "s.title.query").alias("topic_id"),
                             F.col("s.title.query").alias("label"), _position_score(F.col("i")).alias("score"))
        stories = parsed.select("feed_id", F.posexplode("_p.storySummaries.trendingStories").alias("i", "s"))
        title = F.coalesce("s.title", F.lit(""))
        label = F.when(title == "", F.array_join(F.coalesce("s.entityNames", F.array().cast("array<string>")), ", ")).otherwise(title)
        told = stories.select("feed_id", F.lit("google").alias("source"),
                              F.concat(F.lit("google_story_"), F.col("i")).alias("topic_id"), label.alias("label"),
                              _position_score(F.col("i")).alias("score")).filter(F.col("label") != "")
        return daily.unionByName(told)
    raise ValueError(f"unknown feed kind: {kind}")


# -- SRC-7 --------------------------------------------------------------------------

RANK_RESPONSE = ("clips array<struct<index:bigint,score:bigint,hook:string,refined_start_secs:double,"
                 "refined_end_secs:double,reasoning:string,trend_match:string,hook_type:string>>")
REFINE_MS = 5_000   # fixed value: how far a refined bound may move


def clamp_refined(start: Column, end: Column, new_start: Column, new_end: Column,
                  drift: int = REFINE_MS) -> tuple[Column, Column]:
    """RK-2: refined bounds held within ``drift`` of the window's own."""
    s = F.least(F.greatest(new_start, F.greatest(start - drift, F.lit(0))), start + drift)
    e = F.least(F.greatest(new_end, end - drift), end + drift)
    return s, F.when(e <= s, F.greatest(end, s + 1000)).otherwise(e)


def read_rank_responses(responses: DataFrame, candidates: DataFrame, size: int = 10,
                        strict: bool = False) -> DataFrame:
    """Ranked rows from batch answers (episode_id, batch_idx, response).

    Indices are local to a batch. One at or past the batch size is still accepted if it
    meets a later candidate of the episode; ``strict`` rejects it. ``candidates`` carries
    candidate_index, start_ms and end_ms.
    """
    rows = (responses.select("episode_id", "batch_idx", F.posexplode(
        F.from_json("response", RANK_RESPONSE)["clips"]).alias("pos", "c"))
        .select("episode_id", "batch_idx", "pos", "c.*").filter(F.col("index") >= 0))
    if strict:
        rows = rows.filter(F.col("index") < size)
    rows = rows.withColumn("candidate_index", F.col("batch_idx") * size + F.col("index"))
    # Both sides grow with the input. A file of numbers is far smaller than its rows in memory, so the
    # size check would broadcast millions of them.
    hit = rows.join(candidates.select("episode_id", "candidate_index", "start_ms", "end_ms").hint("merge"),
                    ["episode_id", "candidate_index"])
    s, e = clamp_refined(F.col("start_ms"), F.col("end_ms"),
                         to_ms(F.coalesce("refined_start_secs", F.lit(0.0))),
                         to_ms(F.coalesce("refined_end_secs", F.lit(0.0))))

    def optional(c, fold=False):
        t = trim_ws(c)
        return F.nullif(F.lower(t) if fold else t, F.lit(""))

    score = clamp_score("score").cast("bigint")
    return hit.select(
        "episode_id", "candidate_index", "batch_idx", "pos", s.alias("start_ms"), e.alias("end_ms"),
        score.alias("score"), trim_ws(F.coalesce("hook", F.lit(""))).alias("hook"),
        trim_ws(F.coalesce("reasoning", F.lit(""))).alias("reasoning"),
        optional("trend_match").alias("trend_match"), optional("hook_type", True).alias("hook_type"),
        score.alias("llm_score"))


# -- SRC-8 --------------------------------------------------------------------------

def read_post_stats(df: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """Statistics rows from platform answers (clip_id, platform, fetched_at, body).

    ``video`` answers carry counts as text; ``thread`` answers carry numbers. An answer
    without an item gives a row of NULL metrics.
    """
    none = F.lit(None)
    if kind == "video":
        item = F.get(F.from_json(body, "items array<struct<statistics:struct<viewCount:string,likeCount:string,"
                                       "commentCount:string>>>")["items"], F.lit(0))["statistics"]
        got = {"views": item["viewCount"].try_cast("bigint"), "likes": item["likeCount"].try_cast("bigint"),
               "reposts": none.cast("bigint"), "replies": item["commentCount"].try_cast("bigint")}
    elif kind == "thread":
        post = F.from_json(body, "thread struct<post:struct<likeCount:bigint,repostCount:bigint,replyCount:bigint>>")["thread"]["post"]
        got = {"views": none.cast("bigint"), "likes": post["likeCount"], "reposts": post["repostCount"],
               "replies": post["replyCount"]}
    else:
        raise ValueError(f"unknown answer kind: {kind}")
    return df.select("clip_id", "platform", "fetched_at", got["views"].alias("views"),
                     none.cast("double").alias("ctr"), none.cast("double").alias("watch_pct"),
                     *[got[c].alias(c) for c in ("likes", "reposts", "replies")])


# -- SRC-10 -------------------------------------------------------------------------

# Defaults of a job's settings.
DEFAULTS = {
    "clip_top_k": 5, "vlm_rerank_enabled": False, "asd_enabled": False, "enhance_audio": False,
    "clip_render_formats": "9x16", "clip_video_crf": 18, "clip_video_preset": "medium",
    "clip_audio_bitrate_kbps": 192, "post_enabled_platforms": "", "post_dry_run": True,
    "clip_min_secs": 10.0, "clip_max_secs": 30.0, "clip_target_secs": 20.0, "clip_stride_secs": 15.0,
    "clip_min_words": 15, "caption_burn_enabled": True, "caption_hook_overlay_enabled": True,
    "caption_font_name": "", "stt_hallucination_guard": "default", "clip_audience_mode": "broad"}


def resolve_params(jobs: DataFrame, defaults: dict | None = None, config: str = "config_json") -> DataFrame:
    """Each job's settings: its JSON overrides on the defaults, every key with its limits.

    A value of the wrong type, or unreadable JSON, leaves the default. Length limits are
    applied in order (min, max, target), each on the result before it.
    """
    base = {**DEFAULTS, **(defaults or {})}
    doc = F.try_parse_json(F.nullif(F.col(config), F.lit("")))
    out = jobs.withColumn("_v", doc)

    def typed(key):
        """(type name of the JSON value, getter)"""
        return F.schema_of_variant(F.try_variant_get("_v", f"$.{key}", "variant"))

    def is_num(key):
        return F.regexp_like(typed(key), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))

    def number(key):
        return F.when(is_num(key), F.try_variant_get("_v", f"$.{key}", "double"))

    def whole(key):
        v = F.try_variant_get("_v", f"$.{key}", "bigint")
        return F.when((typed(key) == "BIGINT") & (v >= 0), v)

    def text(key, blank_ok=False):
        v = F.when(typed(key) == "STRING", F.try_variant_get("_v", f"$.{key}", "string"))
        return v if blank_ok else F.when(trim_ws(v) != "", v)

    def flag(key):
        return F.when(typed(key) == "BOOLEAN", F.try_variant_get("_v", f"$.{key}", "boolean"))

    def keep(col, key):
        return F.coalesce(col, F.lit(base[key]))

    got = {"clip_top_k": keep(F.greatest(whole("clip_top_k"), F.when(whole("clip_top_k").isNotNull(), F.lit(1))), "clip_top_k"),
           "clip_video_crf": keep(F.when(whole("clip_video_crf").isNotNull(), F.least(whole("clip_video_crf"), F.lit(51))), "clip_video_crf"),
           "clip_audio_bitrate_kbps": keep(F.when(whole("clip_audio_bitrate_kbps").isNotNull(), F.least(
               F.greatest(whole("clip_audio_bitrate_kbps"), F.lit(32)), F.lit(512))), "clip_audio_bitrate_kbps"),
           "clip_min_words": keep(whole("clip_min_words"), "clip_min_words")}
    for key in ("vlm_rerank_enabled", "asd_enabled", "enhance_audio", "post_dry_run",
                "caption_burn_enabled", "caption_hook_overlay_enabled"):
        got[key] = keep(flag(key), key)
    for key in ("clip_render_formats", "clip_video_preset", "caption_font_name"):
        got[key] = keep(text(key), key)
    for key in ("post_enabled_platforms", "stt_hallucination_guard", "clip_audience_mode"):
        got[key] = keep(text(key, blank_ok=True), key)
    low = number("clip_min_secs")
    got["clip_min_secs"] = keep(F.when(low.isNotNull(), F.greatest(low, F.lit(5.0))), "clip_min_secs")
    stride = number("clip_stride_secs")
    got["clip_stride_secs"] = keep(F.when(stride > 0, stride), "clip_stride_secs")
    out = out.select("*", *[c.alias(k) for k, c in got.items()])
    high, aim = number("clip_max_secs"), number("clip_target_secs")
    out = out.withColumn("clip_max_secs", keep(F.when(high.isNotNull(), F.greatest(
        high, F.col("clip_min_secs") + 1.0)), "clip_max_secs"))
    out = out.withColumn("clip_target_secs", keep(F.when(aim.isNotNull(), F.least(F.greatest(
        aim, F.col("clip_min_secs")), F.col("clip_max_secs"))), "clip_target_secs"))
    return out.drop("_v")


def generator_limits(params: DataFrame) -> DataFrame:
    """The floors the window generator applies once more to resolved settings."""
    out = params.withColumn("clip_min_secs", F.greatest("clip_min_secs", F.lit(5.0)))
    out = out.withColumn("clip_max_secs", F.greatest(F.col("clip_max_secs"), F.col("clip_min_secs") + 1.0))
    return out.withColumn("clip_target_secs", F.least(F.greatest("clip_target_secs", "clip_min_secs"), "clip_max_secs"))
