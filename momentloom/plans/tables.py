"""The given tables seen as recordings: each model table as a DataFrame and as the SQL
text of the same rule (``SQL``), both in integer milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_MS, SAID_MS = 400, 300
EPOCH_S = 1_704_067_200          # 2024-01-01 UTC
TOKEN = r"([^ \t\n\f\r]+)"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. Zone-less times are read as UTC, the zone of all day buckets."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def docs(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("episode_id"), "text")


def _tokens():
    return F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1))


def word_lists(spark, sf):
    return docs(spark, sf).select("episode_id", _tokens().alias("_ws"))


def words(spark, sf):
    return (docs(spark, sf).select("episode_id", F.posexplode(_tokens()).alias("_p", "text"))
            .select("episode_id", F.col("_p").cast("bigint").alias("pos"), "text",
                    (F.col("_p") * WORD_MS).cast("bigint").alias("start_ms"),
                    (F.col("_p") * WORD_MS + SAID_MS).cast("bigint").alias("end_ms")))


def totals(spark, sf):
    # Generated, not projected: a projected length would be worked out again for every row
    # a join pairs the episode with.
    total = (F.size(_tokens()) * WORD_MS).cast("bigint")
    return docs(spark, sf).select("episode_id", F.explode(F.array(total)).alias("total_ms"))


def silences(spark, sf):
    return (words(spark, sf).filter(F.col("text").rlike(r"[.!?]$"))
            .select("episode_id", F.col("end_ms").alias("start_ms"),
                    (F.col("end_ms") + 100).alias("end_ms")))


def shots(spark, sf):
    return (words(spark, sf).filter(F.col("pos") % 97 == 96)
            .select("episode_id", F.col("start_ms").alias("t_ms")))


def boundaries(spark, sf):
    """Both kinds of boundary from one pass over the words."""
    ends, cut = F.col("text").rlike(r"[.!?]$"), F.col("pos") % 97 == 96
    mark = lambda at, kind, first, side: F.struct(at.alias("b_ms"), F.lit(kind).alias("kind"), F.struct(first.alias("_s"), F.lit(side).alias("_side")).alias("ord"))
    end, start = F.col("end_ms"), F.col("start_ms")
    marks = F.array_compact(F.array(F.when(ends, mark(end, "silence", end, 0)), F.when(ends, mark(end + 100, "silence", end, 1)),
                                    F.when(cut, mark(start, "shot", start, 0))))
    return words(spark, sf).filter(ends | cut).select("episode_id", F.inline(marks))


def speech(spark, sf):
    """Spoken stretches of eight words, every third stretch missing."""
    return (words(spark, sf).filter((F.col("pos") % 8 == 0) & (F.floor(F.col("pos") / 8) % 3 != 2))
            .select("episode_id", "start_ms", (F.col("start_ms") + 8 * WORD_MS).alias("end_ms")))


def events(spark, sf):
    return (read(spark, sf, "events")
            .withColumn("episode_id", F.col("user_id"))
            .withColumn("t_ms", F.unix_millis("ts") - EPOCH_S * 1000))


def curve(spark, sf, event_type, value):
    return (events(spark, sf).filter(F.col("event_type") == event_type)
            .select("episode_id", "t_ms", F.col("value").alias(value)))


def audio_spans(spark, sf):
    v = F.col("value")
    return (events(spark, sf).filter(F.col("event_type") == "purchase")
            .select("episode_id", F.col("t_ms").alias("start_ms"),
                    (F.col("t_ms") + 21_600_000).alias("end_ms"),
                    v.alias("laughter"), (v * 2).alias("applause"),
                    (v + 1).alias("music"), (v / 2).alias("speech")))


def event_windows(spark, sf):
    """Six-hour windows every four hours over the 30 days of each user's events. They are far more
    than the file of events lets expect, so joins with them are merged, not broadcast."""
    users = events(spark, sf).groupBy("episode_id").agg(F.max("t_ms").alias("_last"))
    return (users.select("episode_id", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor(F.col("_last") / 14_400_000))).alias("window_id"))
        .select("episode_id", "window_id", (F.col("window_id") * 14_400_000).alias("start_ms"),
                (F.col("window_id") * 14_400_000 + 21_600_000).alias("end_ms")).hint("merge"))


def frames(spark, sf):
    """Speech probability frames: one per token, low for short tokens."""
    return words(spark, sf).select("episode_id", F.col("pos").alias("frame_idx"),
                                   (F.length("text") / 10.0).alias("prob"))


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("episode_id"),
        F.col("vec_id").alias("window_id"), F.col("embedding").alias("v"))


def jobs(spark, sf):
    status = (F.when(F.col("o_orderstatus") == "F", "done")
              .when(F.col("o_orderstatus") == "O", "pending")
              .otherwise(F.element_at(F.array(*[F.lit(s) for s in (
                  "transcribed", "ranked", "rendered", "posted", "failed", "cancelled",
                  "unheard")]), (F.col("o_orderkey") % 7 + 1).cast("int"))))
    created = F.unix_seconds(F.col("o_orderdate"))
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("show_"), F.col("o_custkey") % 25).alias("show_slug"),
        status.alias("status"), created.alias("created_at"),
        (created + F.col("o_orderkey") % 7919).alias("updated_at"),
        F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("cost_cents"),
        F.when(F.col("o_orderkey") % 11 == 3, F.lit("boom")).alias("error"))


def clips(spark, sf):
    k = F.col
    start = k("l_linenumber") * 60_000 + k("l_suppkey") * 100
    return read(spark, sf, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    k("l_quantity").cast("int"), k("l_extendedprice").cast("bigint")).alias("id"),
        k("l_orderkey").alias("job_id"), start.cast("bigint").alias("start_ms"),
        (start + k("l_quantity") * 1000).cast("bigint").alias("end_ms"),
        k("l_linenumber").cast("bigint").alias("rank"),
        (F.round(k("l_discount") * 100) * 9 + k("l_linenumber")).cast("bigint").alias("score"),
        F.when(k("l_partkey") % 5 != 0, F.concat(F.lit("hook "), k("l_partkey"))).alias("hook"),
        F.when(k("l_suppkey") % 3 == 0, F.concat(F.lit("k"), k("l_partkey") % 100)).alias("trend_match"),
        F.when(k("l_returnflag") != "R", F.lower("l_returnflag")).alias("hook_type"),
        F.when(k("l_linestatus") == "O", "generated").otherwise("approved").alias("status"),
        F.unix_seconds("l_shipdate").alias("created_at"), k("l_tax").alias("tax"))


def clip_posts(spark, sf):
    """One or two posts per clip on platforms chosen by its rank."""
    c = clips(spark, sf)
    name = F.element_at(F.array(*[F.lit(p) for p in ("youtube", "bluesky", "linkedin", "threads")]),
                        (F.col("rank") % 4 + 1).cast("int"))
    return c.select(
        F.col("id").alias("clip_id"), "job_id", name.alias("platform"),
        F.when(F.col("score") % 4 == 0, "failed").when(F.col("score") % 4 == 1, "vetoed")
        .otherwise("posted").alias("status"),
        F.when(F.col("score") % 6 != 0, F.concat(F.lit("x"), "rank")).alias("external_id"),
        (F.col("created_at") + 3600 * F.col("rank")).alias("posted_at"))


def stat_posts(spark, sf):
    """Posts of the statistics tables: (clip, platform) of the events, posted a day
    before a first look."""
    return (analytics(spark, sf).groupBy("clip_id", "platform")
            .agg((F.min("fetched_at") - 86_400).alias("posted_at"),
                 F.max("views").alias("_v"))
            .select("clip_id", "platform", F.when(F.col("_v") % 5 == 0, "failed")
                    .otherwise("posted").alias("status"),
                    F.when(F.col("_v") % 7 != 0, F.concat(F.lit("x"), "clip_id"))
                    .otherwise("").alias("external_id"), "posted_at"))


PLATFORM_OF = {"view": "youtube", "click": "bluesky", "purchase": "linkedin",
               "signup": "threads"}


def analytics(spark, sf):
    platform = F.col("event_type")
    for kind, name in PLATFORM_OF.items():
        platform = F.when(F.col("event_type") == kind, name).otherwise(platform)
    m = F.col("event_id") % 3
    return read(spark, sf, "events").select(
        F.col("user_id").alias("clip_id"), platform.alias("platform"),
        F.unix_seconds("ts").alias("fetched_at"),
        F.floor(F.col("value") * 100).cast("bigint").alias("views"),
        F.when(m != 0, F.col("value")).alias("ctr"),
        F.when(m != 1, F.col("value") / 4).alias("watch_pct"),
        F.when(m != 2, F.col("event_id") % 50).alias("likes"),
        F.lit(None).cast("bigint").alias("reposts"), (F.col("event_id") % 9).alias("replies"),
        "event_id")


def stat_clips(spark, sf):
    """Clips of the statistics tables: one per customer that has events."""
    return read(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40).alias("job_id"),
        F.lit(0).cast("bigint").alias("start_ms"),
        ((F.col("c_custkey") % 50 + 10) * 1000).cast("bigint").alias("end_ms"),
        F.when(F.col("c_custkey") % 6 != 0, F.col("c_name")).alias("hook"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 101).alias("score"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("k"), F.col("c_custkey") % 100))
        .alias("trend_match"), F.lower("c_mktsegment").alias("hook_type"),
        F.concat(F.lit("show_"), "c_nationkey").alias("show_slug"),
        F.col("c_custkey").alias("rank"))


def trends(spark, sf):
    """Trend snapshots; a repeated (source, topic, time) keeps its last row."""
    topic = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    return (read(spark, sf, "events")
            .groupBy(F.col("event_type").alias("source"), topic.alias("topic_id"),
                     F.unix_seconds("ts").alias("fetched_at"))
            .agg(F.max_by("value", "event_id").alias("score"))
            .withColumn("label", F.concat(F.lit("topic "), "topic_id")))


def usage(spark, sf):
    k = F.col
    model = F.element_at(F.array(*[F.lit(m) for m in USAGE_MODELS]),
                         (k("l_partkey") % len(USAGE_MODELS) + 1).cast("int"))
    cat = F.element_at(F.array(*[F.lit(c) for c in USAGE_CATEGORIES]),
                       (k("l_linenumber") % len(USAGE_CATEGORIES) + 1).cast("int"))
    return read(spark, sf, "lineitem").select(
        k("l_orderkey").alias("job_id"), cat.alias("category"), model.alias("model"),
        (k("l_quantity") * 100).cast("bigint").alias("input_tokens"),
        (k("l_quantity") * 10).cast("bigint").alias("output_tokens"),
        (k("l_quantity") / 4).alias("audio_s"), (k("l_quantity") * 37).cast("bigint").alias("chars"))


USAGE_MODELS = ["whisper-large-v3", "whisper-large-v3-turbo", "whisper-x", "gpt-4o-mini",
                "gpt-5-nano", "bge-m3", "qwen/qwen3-32b", "mystery"]
USAGE_CATEGORIES = ["stt", "chat", "embeddings", "vlm", "vlm_premium"]

_CTES = {
    "docs": "docs AS (SELECT doc_id AS episode_id, text FROM documents)",
    "toks": r"toks AS (SELECT episode_id, regexp_extract_all(text, '[^ \t\n\f\r]+') AS toks FROM docs)",
    "words": """words AS (SELECT episode_id, CAST(p - 1 AS BIGINT) AS pos, text,
        CAST(400 * (p - 1) AS BIGINT) AS start_ms, CAST(400 * (p - 1) + 300 AS BIGINT) AS end_ms
        FROM (SELECT episode_id, unnest(toks) AS text, generate_subscripts(toks, 1) AS p FROM toks))""",
    "totals": "totals AS (SELECT episode_id, CAST(len(toks) * 400 AS BIGINT) AS total_ms FROM toks)",
    "silences": """silences AS (SELECT episode_id, end_ms AS start_ms, end_ms + 100 AS end_ms
        FROM words WHERE regexp_matches(text, '[.!?]$'))""",
    "shots": "shots AS (SELECT episode_id, start_ms AS t_ms FROM words WHERE pos % 97 = 96)",
    "speech": """speech AS (SELECT episode_id, start_ms, start_ms + 3200 AS end_ms FROM words
        WHERE pos % 8 = 0 AND (pos // 8) % 3 <> 2)""",
    "ev": f"""ev AS (SELECT *, user_id AS episode_id, epoch_us(ts) // 1000 - {EPOCH_S * 1000} AS t_ms FROM events)""",
    "evwin": """evwin AS (SELECT episode_id, w AS window_id, w * 14400000 AS start_ms,
        w * 14400000 + 21600000 AS end_ms FROM (SELECT episode_id,
        unnest(generate_series(0::BIGINT, max(t_ms) // 14400000)) AS w FROM ev GROUP BY episode_id))""",
    "spans": """spans AS (SELECT episode_id, t_ms AS start_ms, t_ms + 21600000 AS end_ms, value AS laughter,
        value * 2 AS applause, value + 1 AS music, value / 2 AS speech FROM ev WHERE event_type = 'purchase')""",
    "frames": """frames AS (SELECT episode_id, pos AS frame_idx, length(text) / 10.0::DOUBLE AS prob FROM words)""",
    "vectors": """vectors AS (SELECT CAST(label AS BIGINT) AS episode_id, vec_id AS window_id, embedding AS v
        FROM embeddings)""",
    "jobs": """jobs AS (SELECT o_orderkey AS id, 'show_' || (o_custkey % 25) AS show_slug,
        CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE
          (['transcribed','ranked','rendered','posted','failed','cancelled','unheard'])[o_orderkey % 7 + 1] END AS status,
        CAST(epoch(o_orderdate) AS BIGINT) AS created_at,
        CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 7919 AS updated_at,
        CAST(floor(o_totalprice * 100) AS BIGINT) AS cost_cents,
        CASE WHEN o_orderkey % 11 = 3 THEN 'boom' END AS error FROM orders)""",
    "clips": """clips AS (SELECT concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber,
          CAST(trunc(l_quantity) AS INTEGER), CAST(trunc(l_extendedprice) AS BIGINT)) AS id, l_orderkey AS job_id,
        CAST(l_linenumber * 60000 + l_suppkey * 100 AS BIGINT) AS start_ms,
        CAST(l_linenumber * 60000 + l_suppkey * 100 + l_quantity * 1000 AS BIGINT) AS end_ms,
        CAST(l_linenumber AS BIGINT) AS rank,
        CAST(round(l_discount * 100) * 9 + l_linenumber AS BIGINT) AS score,
        CASE WHEN l_partkey % 5 <> 0 THEN 'hook ' || l_partkey END AS hook,
        CASE WHEN l_suppkey % 3 = 0 THEN 'k' || (l_partkey % 100) END AS trend_match,
        CASE WHEN l_returnflag <> 'R' THEN lower(l_returnflag) END AS hook_type,
        CASE WHEN l_linestatus = 'O' THEN 'generated' ELSE 'approved' END AS status,
        CAST(epoch(l_shipdate) AS BIGINT) AS created_at, l_tax AS tax FROM lineitem)""",
    "clip_posts": """clip_posts AS (SELECT id AS clip_id, job_id,
        (['youtube','bluesky','linkedin','threads'])[rank % 4 + 1] AS platform,
        CASE score % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'vetoed' ELSE 'posted' END AS status,
        CASE WHEN score % 6 <> 0 THEN 'x' || rank END AS external_id,
        created_at + 3600 * rank AS posted_at FROM clips)""",
    "stats": """stats AS (SELECT user_id AS clip_id, CASE event_type WHEN 'view' THEN 'youtube'
          WHEN 'click' THEN 'bluesky' WHEN 'purchase' THEN 'linkedin' WHEN 'signup' THEN 'threads'
          ELSE event_type END AS platform,
        CAST(floor(epoch(ts)) AS BIGINT) AS fetched_at, CAST(floor(value * 100) AS BIGINT) AS views,
        CASE WHEN event_id % 3 <> 0 THEN value END AS ctr,
        CASE WHEN event_id % 3 <> 1 THEN value / 4 END AS watch_pct,
        CASE WHEN event_id % 3 <> 2 THEN event_id % 50 END AS likes,
        CAST(NULL AS BIGINT) AS reposts, event_id % 9 AS replies, event_id FROM events)""",
    "stat_posts": """stat_posts AS (SELECT clip_id, platform,
        CASE WHEN v % 5 = 0 THEN 'failed' ELSE 'posted' END AS status,
        CASE WHEN v % 7 <> 0 THEN 'x' || clip_id ELSE '' END AS external_id, posted_at
        FROM (SELECT clip_id, platform, min(fetched_at) - 86400 AS posted_at, max(views) AS v
              FROM stats GROUP BY ALL))""",
    "stat_clips": """stat_clips AS (SELECT c_custkey AS id, c_custkey % 40 AS job_id, 0::BIGINT AS start_ms,
        CAST((c_custkey % 50 + 10) * 1000 AS BIGINT) AS end_ms,
        CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS hook,
        CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 101 END AS score,
        CASE WHEN c_custkey % 3 = 0 THEN 'k' || (c_custkey % 100) END AS trend_match,
        lower(c_mktsegment) AS hook_type, 'show_' || c_nationkey AS show_slug, c_custkey AS rank FROM customer)""",
    "trends": """trends AS (SELECT *, 'topic ' || topic_id AS label FROM (SELECT event_type AS source,
        'k' || json_extract_string(props, '$.k') AS topic_id, CAST(floor(epoch(ts)) AS BIGINT) AS fetched_at,
        arg_max(value, event_id) AS score FROM events GROUP BY ALL))""",
    "usage": """usage AS (SELECT l_orderkey AS job_id,
        (['stt','chat','embeddings','vlm','vlm_premium'])[l_linenumber % 5 + 1] AS category,
        (['whisper-large-v3','whisper-large-v3-turbo','whisper-x','gpt-4o-mini','gpt-5-nano','bge-m3',
          'qwen/qwen3-32b','mystery'])[l_partkey % 8 + 1] AS model,
        CAST(l_quantity * 100 AS BIGINT) AS input_tokens, CAST(l_quantity * 10 AS BIGINT) AS output_tokens,
        l_quantity / 4 AS audio_s, CAST(l_quantity * 37 AS BIGINT) AS chars FROM lineitem)""",
}
_NEEDS = {"toks": ["docs"], "words": ["toks"], "totals": ["toks"], "silences": ["words"],
          "shots": ["words"], "speech": ["words"], "evwin": ["ev"], "spans": ["ev"],
          "frames": ["words"], "clip_posts": ["clips"], "stat_posts": ["stats"]}


def sql(body: str, *names: str, recursive: bool = False, extra: str = "") -> str:
    """``body`` behind the CTEs of the named model tables (and what they need)."""
    order: list[str] = []

    def add(name):
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [_CTES[n] for n in order] + ([extra] if extra else [])
    head = "WITH " + ("RECURSIVE " if recursive else "")
    return (head + ",\n".join(parts) + "\n" if parts else "") + body
