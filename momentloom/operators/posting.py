"""Post plans, post texts, quotas and withdrawals (PST-1..4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp_chars, let, trim_ws
from .scaling import top_n

# -- PST-1 --------------------------------------------------------------------------

def plan_posts(clips: DataFrame, renders: DataFrame, copy: DataFrame, targets: list[str],
               dry_run: bool = False) -> DataFrame:
    """(clip_id, platform, status, reason): one row per clip and target.

    ``targets`` are the run's platform names. Only the fact that a portrait render and a
    text exist is joined, one flag row per clip.
    """
    tall = renders.filter(F.col("variant") == "9x16").select("clip_id").distinct().withColumn("_r", F.lit(True))
    told = copy.select("clip_id").distinct().withColumn("_c", F.lit(True))
    flagged = clips.select("clip_id").join(tall, "clip_id", "left").join(told, "clip_id", "left")
    rows = flagged.withColumn("platform", F.explode(F.array(*[F.lit(t) for t in targets])))
    reason = (F.when(F.col("_r").isNull(), "9x16 variant missing")
              .when(F.col("_c").isNull(), "no social copy for this clip"))
    return rows.select("clip_id", "platform", F.when(reason.isNotNull(), "skipped")
                       .otherwise("dry_run" if dry_run else "pending").alias("status"), reason.alias("reason"))


# -- PST-2 --------------------------------------------------------------------------

# Parsed social copy: text blocks and tag lists of every platform.
COPY_SCHEMA = (
    "youtube_shorts struct<title:string,description:string,hashtags:array<string>,pinned_comment:string>, "
    "tiktok struct<caption:string,hashtags:array<string>>, instagram_reels struct<caption:string,hashtags:array<string>>, "
    "threads struct<text:string,hashtags:array<string>>, linkedin struct<post_text:string,hashtags:array<string>>, "
    "x struct<text:string,hashtags:array<string>>, bluesky struct<text:string,hashtags:array<string>>, "
    "overlay_hook string, hook_source string")


def parse_copy(df: DataFrame, json: str = "social_copy_json", out: str = "copy") -> DataFrame:
    return df.withColumn(out, F.from_json(json, COPY_SCHEMA))


def _text(path: str) -> Column:
    return trim_ws(F.coalesce(F.col(path), F.lit("")))


def _tags(path: str) -> Column:
    return F.coalesce(F.col(path), F.array().cast("array<string>"))


def _hash_tags(path: str) -> Column:
    """Each tag with exactly one leading #, blank ones dropped."""
    bare = F.transform(_tags(path), lambda t: trim_ws(F.regexp_replace(t, "^#+", "")))
    return F.transform(F.filter(bare, lambda t: t != ""), lambda t: F.concat(F.lit("#"), t))


def _plain_tags(path: str) -> Column:
    """Each trimmed tag with a # put in front unless it has one."""
    return F.transform(F.transform(_tags(path), trim_ws), lambda t: F.when(
        F.startswith(t, F.lit("#")), t).otherwise(F.concat(F.lit("#"), t)))


def _with_tags(body: Column, tags: Column) -> Column:
    def join(p):
        return (F.when(p["line"] == "", p["body"]).when(p["body"] == "", p["line"])
                .otherwise(F.concat(p["body"], F.lit("\n\n"), p["line"])))

    return let(F.struct(body.alias("body"), F.array_join(tags, " ").alias("line")), join)


def _with_new_tags(body: Column, tags: Column) -> Column:
    """The body with those tags it does not contain yet."""
    return let(body, lambda b: _with_tags(b, F.filter(tags, lambda t: ~F.contains(b, t))))


# Length limits in characters.
LIMITS = {"bluesky": 300, "threads": 500, "x": 280, "instagram": 2200, "ayrshare": 2200, "youtube_title": 100}


def post_texts(services: list[str]) -> dict[str, Column]:
    """Text of the post on every platform, from a parsed ``copy`` column. ``services`` are
    the networks an aggregator account serves; they choose which caption it takes."""
    yt_body = F.when(F.coalesce("copy.youtube_shorts.description", F.lit("")) == "", F.coalesce("copy.youtube_shorts.title", F.lit(""))
                     ).otherwise(F.concat(F.coalesce("copy.youtube_shorts.title", F.lit("")), F.lit("\n\n"), "copy.youtube_shorts.description"))
    insta = _text("copy.instagram_reels.caption")
    tik = _text("copy.tiktok.caption")
    desc = _text("copy.youtube_shorts.description")
    marked = F.contains(F.lower(desc), F.lit("#shorts"))
    first = F.lit("tiktok" in services) & (tik != "")
    second = F.lit("instagram" in services) & (insta != "")
    pick = (F.when(first, "t").when(second, "i").when(tik != "", "t").when(insta != "", "i").otherwise("y"))
    cap = F.when(pick == "t", tik).when(pick == "i", insta).otherwise(desc)
    cap_tags = (F.when(pick == "t", _plain_tags("copy.tiktok.hashtags"))
                .when(pick == "i", _plain_tags("copy.instagram_reels.hashtags"))
                .otherwise(_plain_tags("copy.youtube_shorts.hashtags")))
    return {
        "x": clamp_chars(_with_tags(_text("copy.x.text"), _hash_tags("copy.x.hashtags")), LIMITS["x"], "ellipsis"),
        "linkedin": _with_tags(_text("copy.linkedin.post_text"), _hash_tags("copy.linkedin.hashtags")),
        "threads": clamp_chars(_with_tags(_text("copy.threads.text"), _hash_tags("copy.threads.hashtags")), LIMITS["threads"], "ellipsis"),
        "tiktok": _with_tags(tik, _hash_tags("copy.tiktok.hashtags")),
        "instagram_browser": _with_tags(insta, _hash_tags("copy.instagram_reels.hashtags")),
        "bluesky_browser": _with_tags(_text("copy.bluesky.text"), _hash_tags("copy.bluesky.hashtags")),
        "youtube_browser": _with_tags(trim_ws(yt_body), _hash_tags("copy.youtube_shorts.hashtags")),
        "bluesky": clamp_chars(_with_tags(_text("copy.bluesky.text"), _plain_tags("copy.bluesky.hashtags")), LIMITS["bluesky"], "dots"),
        "instagram": clamp_chars(_with_new_tags(insta, _plain_tags("copy.instagram_reels.hashtags")), LIMITS["instagram"], "dots"),
        "youtube": F.when(marked, desc).when(desc == "", "#Shorts").otherwise(F.concat(desc, F.lit("\n#Shorts"))),
        "ayrshare": F.when(cap == "", "").otherwise(clamp_chars(_with_new_tags(cap, cap_tags), LIMITS["ayrshare"], "dots"))}


def compose_posts(clips: DataFrame, services: list[str] | None = None) -> DataFrame:
    """(clip_id, platform, title, text) for every platform of each clip's ``copy``; one
    scan, platforms unpivoted in the row."""
    texts = post_texts(services or [])
    title = clamp_chars(F.coalesce("copy.youtube_shorts.title", F.lit("")), LIMITS["youtube_title"])
    rows = F.array(*[F.struct(F.lit(p).alias("platform"), (title if p == "youtube" else F.lit(None).cast("string")).alias("title"),
                              c.alias("text")) for p, c in texts.items()])
    return clips.select("clip_id", F.inline(rows))


# -- PST-3 --------------------------------------------------------------------------

UPLOAD_COST, DAILY_UNITS = 1_600, 10_000   # fixed values


def admit_by_quota(plan: DataFrame, cost: int = UPLOAD_COST, limit: int = DAILY_UNITS,
                   order: list[str] | None = None) -> DataFrame:
    """Adds ``admitted``: uploads that fit the account's units of their UTC day.

    All uploads cost the same, so a day admits its first limit/cost rows; only those are
    ranked and shipped, whatever the size of the day. ``plan``: account, planned_at, and a
    unique ``plan_id``. A daily cap is ``cost=1, limit=cap``.
    """
    day = F.date_format(F.timestamp_seconds("planned_at"), "yyyy-MM-dd")
    dated = plan.withColumn("day", day)
    order = order or ["planned_at", "plan_id"]
    first = top_n(dated.select("account", "day", *order), ["account", "day"], order, limit // cost)
    return (dated.join(first.select("plan_id", F.lit(True).alias("_in")), "plan_id", "left")
            .withColumn("admitted", F.coalesce("_in", F.lit(False))).drop("_in"))


# -- PST-4 --------------------------------------------------------------------------

def resolve_vetoes(directives: DataFrame, clips: DataFrame, posts: DataFrame, platforms: list[str]) -> DataFrame:
    """Outcome rows (message_id, label, platform, success, detail) of withdrawal directives.

    ``directives``: message_id, episode_id, label; ``clip_03`` means rank 3 of the episode.
    ``detail`` is ``to remove`` where a configured platform has to be called.
    """
    rank = F.regexp_extract("label", r"(\d+)$", 1).try_cast("bigint")
    named = directives.withColumn("rank", rank).join(
        clips.select("episode_id", "rank", "clip_id"), ["episode_id", "rank"], "left")
    rows = named.join(posts.select("clip_id", "platform", "status", "external_id"), "clip_id", "left")
    none, bare = F.col("clip_id").isNull(), F.col("platform").isNull()
    detail = (F.when(none, F.concat(F.lit("clip '"), "label", F.lit("' not found in database")))
              .when(bare, "no posts found for this clip").when(F.col("status") == "vetoed", "already vetoed")
              .when(F.coalesce("external_id", F.lit("")) == "", "no external_id recorded")
              .when(~F.col("platform").isin(platforms), "platform not configured").otherwise("to remove"))
    return rows.select("message_id", "label", F.when(none | bare, "all").otherwise(F.col("platform")).alias("platform"),
                       detail.alias("detail"), detail.isin("already vetoed", "to remove").alias("success"))


def veto_confirmation(outcomes: DataFrame) -> DataFrame:
    """(message_id, text): the reply to each message, labels and platforms in order."""
    line = F.concat(F.lit("  ["), F.when(F.col("success"), "OK").otherwise("FAIL"), F.lit("] "), "platform",
                    F.lit(": "), F.when(F.col("detail") == "to remove", "removed").otherwise(F.col("detail")), F.lit("\n"))
    per = outcomes.groupBy("message_id", "label").agg(F.array_sort(F.collect_list(line)).alias("_l"))
    block = F.concat("label", F.lit(":\n"), F.array_join("_l", ""), F.lit("\n"))
    out = per.groupBy("message_id").agg(F.array_sort(F.collect_list(block)).alias("_b"))
    return out.select("message_id", F.concat(F.lit("Veto results:\n\n"), F.array_join("_b", "")).alias("text"))
