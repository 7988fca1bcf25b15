"""FN-1..16 over the documents, pages, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reports
from . import tables as t
from .catalog import query
from .tables import sql

# Phrases put in front of the given texts, which have no markers of their own.
PHRASES = ["No wait, that's not right. Hold on.", "Honestly, that was nuts. The truth is odd?",
           "I'll be honest, I've never told anyone.", "So anyway, speaking of which, moving on!",
           "In 2024 we did 50,000 reps and ran 3.5 miles?", "Plain opening words here."]
_SQL_PHRASES = "[" + ",".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
SAID = f"said AS (SELECT doc_id, ({_SQL_PHRASES})[doc_id % 6 + 1] || ' ' || text AS text FROM documents)"


def said(spark, sf):
    d = t.read(spark, sf, "documents")
    lead = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select("doc_id", F.concat(lead, F.lit(" "), F.col("text")).alias("text"))


def _alt(name):
    return "|".join(T.LEXICON[name]).replace("'", "''")


def _count(expr):
    return f"CAST(len(regexp_extract_all(text, '{expr}')) AS BIGINT)"


@query("fn_01_marker_counts", "WITH " + SAID + " SELECT doc_id, " + ", ".join(
    _count(rf"(?i)\b(?:{_alt(n)})\b") + f" AS {n}" for n in T.LEXICON) + " FROM said")
def fn1(spark, sf):
    return said(spark, sf).select("doc_id", *[c.alias(n) for n, c in T.marker_counts("text").items()])


@query("fn_02_numbers_questions", "WITH " + SAID + r""" SELECT doc_id,
  CAST(len(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '\b\d[\d,\.]*\b')) AS BIGINT) AS numbers,
  CAST(length(text) - length(replace(text, '?', '')) AS BIGINT) AS questions FROM said""")
def fn2(spark, sf):
    return said(spark, sf).select("doc_id", T.number_count("text").alias("numbers"),
                                  T.question_count("text").alias("questions"))


_SENTS = r"""sents AS (SELECT doc_id, text, list_filter(list_transform(
   regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[.!?]+(?:\s+|$)'),
   lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM said),
 lens AS (SELECT *, list_transform(s, lambda x: len(regexp_extract_all(x, '\S+'))) AS n FROM sents)"""


@query("fn_03_sentences", "WITH " + SAID + ", " + _SENTS + r""" SELECT doc_id, CAST(len(s) AS BIGINT) AS sentence_count,
  round(CASE WHEN len(s) > 0 THEN list_sum(n) / len(s) ELSE 0 END, 6) AS avg_sentence_words,
  CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS total_words FROM lens""")
def fn3(spark, sf):
    d = T.text_features(said(spark, sf), "text", "f")
    return d.select("doc_id", "f.sentence_count", F.round("f.avg_sentence_words", 6)
                    .alias("avg_sentence_words"), "f.total_words")


@query("fn_04_short_declaratives", "WITH " + SAID + ", " + _SENTS + r""",
  sh AS (SELECT doc_id, list_filter(list_transform(s, lambda x, i:
     {'n': len(regexp_extract_all(x, '\S+')), 'pos': i, 'text': x}),
     lambda r: NOT contains(r.text, '?') AND r.n > 0 AND r.n <= 12) AS q FROM lens)
  SELECT doc_id, CAST(len(q) AS BIGINT) AS short_declaratives,
    list_aggregate(list_transform(list_slice(list_sort(q), 1, 2), lambda r: r.text), 'string_agg', ' | ')
      AS quotable FROM sh""")
def fn4(spark, sf):
    d = T.text_features(said(spark, sf), "text", "f")
    joined = F.array_join("f.quotable_lines", " | ")
    return d.select("doc_id", "f.short_declaratives",
                    F.when(F.size("f.quotable_lines") > 0, joined).alias("quotable"))


_SCRIPTS = ["สวัสดี ", "안녕 ", "Привет ", "", "漢字 "]


@query("fn_05_foreign_script", f"""SELECT doc_id, regexp_matches(
  ([{','.join("'" + s + "'" for s in _SCRIPTS)}])[doc_id % 5 + 1] || text, '[{''.join(
      chr(92) + 'x{' + a + '}-' + chr(92) + 'x{' + b + '}' for a, b in T.FOREIGN_RANGES)}]') AS foreign_script
  FROM documents""")
def fn5(spark, sf):
    lead = F.element_at(F.array(*[F.lit(s) for s in _SCRIPTS]), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.read(spark, sf, "documents").select(
        "doc_id", T.has_foreign_script(F.concat(lead, F.col("text"))).alias("foreign_script"))


@query("fn_06_trigram_repeat", r"""WITH k AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents),
  g AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 2),
        lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM k WHERE len(w) >= 6),
  c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL),
  m AS (SELECT doc_id, max(n) AS best FROM c GROUP BY doc_id)
  SELECT k.doc_id, CAST(coalesce(best, 0) AS BIGINT) AS max_repeat FROM k LEFT JOIN m USING (doc_id)""")
def fn6(spark, sf):
    return T.max_trigram_repeat(t.read(spark, sf, "documents"), ["doc_id"], "text")


@query("fn_07_slugify", r"""SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'),
  '^_+|_+$', '', 'g')) AS slug FROM documents""")
def fn7(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", T.slugify("text").alias("slug"))


@query("fn_08_time_formats", """WITH s AS (SELECT o_orderkey AS id, o_totalprice / 50 AS secs, epoch(o_orderdate)::BIGINT AS u FROM orders),
  x AS (SELECT *, CAST(trunc(secs) AS BIGINT) AS n FROM s)
  SELECT id, printf('%02d:%02d', n // 60, n % 60) AS mmss,
   CASE WHEN n >= 3600 THEN printf('%dh %02dm %02ds', n // 3600, (n % 3600) // 60, n % 60)
        ELSE printf('%dm %02ds', n // 60, n % 60) END AS hms,
   printf('%dm %ds', n // 60, n % 60) AS duration,
   strftime(make_timestamp(u * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM x""")
def fn8(spark, sf):
    o = t.read(spark, sf, "orders")
    s = F.col("o_totalprice") / 50
    return o.select(F.col("o_orderkey").alias("id"), T.fmt_mmss(s).alias("mmss"), T.fmt_hms(s).alias("hms"),
                    T.fmt_duration(s).alias("duration"), T.fmt_iso(F.unix_seconds("o_orderdate")).alias("iso"))


_HOOK = r"""regexp_replace(coalesce(list_aggregate(list_slice(regexp_extract_all({0}, '\S+'), 1, 5), 'string_agg', ' '), ''), '\.+$', '')"""


@query("fn_09_clean_hook", "SELECT doc_id, " + _HOOK.format("text") + " AS hook FROM documents")
def fn9(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", T.clean_hook("text").alias("hook"))


_MODES = ["llm", " Ranker ", "ab", "AB_TEST", "other"]


@query("fn_10_resolve_hook", f"""WITH b AS (SELECT doc_id, doc_id // 5 AS idx,
   CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END AS written, source || ' says hello to all of you.' AS ranked,
   (['llm','ranker','ab_test','ab_test','llm'])[doc_id % 5 + 1] AS mode FROM documents),
  h AS (SELECT *, {_HOOK.format('written')} AS a, {_HOOK.format('ranked')} AS r,
        mode = 'llm' OR (mode = 'ab_test' AND idx % 2 = 0) AS w FROM b)
  SELECT doc_id, CASE WHEN w AND a <> '' THEN a ELSE r END AS hook,
   CASE WHEN w AND a <> '' THEN 'llm' WHEN w THEN 'fallback' ELSE 'ranker' END AS source FROM h""")
def fn10(spark, sf):
    d = t.read(spark, sf, "documents")
    mode = T.hook_mode(F.element_at(F.array(*[F.lit(m) for m in _MODES]), (F.col("doc_id") % 5 + 1).cast("int")))
    d = d.select("doc_id", T.resolve_hook(
        F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("text")),
        F.concat("source", F.lit(" says hello to all of you.")), mode, F.floor(F.col("doc_id") / 5)).alias("h"))
    return d.select("doc_id", "h.hook", "h.source")


@query("fn_11_clamp_chars", """SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE text[1:600] END AS cut,
  CASE WHEN length(text) <= 300 THEN text ELSE text[1:297] || '...' END AS dots,
  CASE WHEN length(text) <= 280 THEN text ELSE text[1:279] || '…' END AS ellipsis FROM documents""")
def fn11(spark, sf):
    return t.read(spark, sf, "documents").select(
        "doc_id", T.clamp_chars("text", 600).alias("cut"), T.clamp_chars("text", 300, "dots").alias("dots"),
        T.clamp_chars("text", 280, "ellipsis").alias("ellipsis"))


@query("fn_12_blend", """SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey,
  CAST(least(greatest(round(0.5 * (l_quantity * 3 - 20) + 0.5 * l_suppkey), 0), 100) AS BIGINT) AS half,
  CAST(least(greatest(round(0.75 * (l_quantity * 3 - 20) + 0.25 * l_suppkey), 0), 100) AS BIGINT) AS quarter
  FROM lineitem""")
def fn12(spark, sf):
    a = F.col("l_quantity") * 3 - 20
    return t.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey",
        T.blend(a, "l_suppkey", 0.5).alias("half"), T.blend(a, "l_suppkey", 0.25).alias("quarter"))


@query("fn_13_job_view", sql("""SELECT id, CASE WHEN status IN ('transcribed','ranked','rendered','posted') THEN 'rendering'
   WHEN status = 'done' THEN 'done' WHEN status IN ('failed','cancelled') THEN 'failed' ELSE 'pending' END AS view_status,
  CASE status WHEN 'pending' THEN 'Queued' WHEN 'transcribed' THEN 'Ranking' WHEN 'ranked' THEN 'Rendering clips'
   WHEN 'rendered' THEN 'Posting' WHEN 'posted' THEN 'Finalizing' WHEN 'done' THEN 'Complete'
   WHEN 'failed' THEN 'Failed' WHEN 'cancelled' THEN 'Cancelled' ELSE 'Unknown' END AS stage,
  CASE status WHEN 'transcribed' THEN 40 WHEN 'ranked' THEN 65 WHEN 'rendered' THEN 85 WHEN 'posted' THEN 95
   WHEN 'done' THEN 100 WHEN 'failed' THEN 0 WHEN 'cancelled' THEN 0 ELSE 5 END AS progress FROM jobs""", "jobs"))
def fn13(spark, sf):
    return reports.job_view(t.jobs(spark, sf)).select("id", "view_status", "stage", "progress")


_BOARD = """, st AS (SELECT * FROM (VALUES (0,'ingest'),(1,'download'),(2,'audio'),(3,'transcribe'),(4,'features'),
   (5,'rank'),(6,'render'),(7,'post')) v(i, stage)),
  a AS (SELECT *, CASE status WHEN 'pending' THEN 0 WHEN 'transcribed' THEN 4 WHEN 'ranked' THEN 6
    WHEN 'rendered' THEN 7 WHEN 'posted' THEN 7 WHEN 'failed' THEN 0 END AS act FROM jobs)
  SELECT id, stage, CASE WHEN status = 'done' THEN 'done'
    WHEN act = i AND (status = 'failed' OR coalesce(error, '') <> '') THEN 'error'
    WHEN act IS NULL THEN 'idle' WHEN i < act THEN 'done' WHEN i = act THEN 'active' ELSE 'idle' END AS stage_status
  FROM a CROSS JOIN st"""


@query("fn_14_stage_board", sql("", "jobs").rstrip() + _BOARD)
def fn14(spark, sf):
    return reports.stage_board(t.jobs(spark, sf)).select("id", "stage", "stage_status")


_LISTS = ["yt, shorts,bluesky", "IG,reels , youtube", "ayrshare,unknown,BSKY", " , bluesky,bsky,yt"]
_FMTS = ["9x16,vertical,square", "16x9, 16X9,foo", "Landscape,1x1,1x1", ""]
_ACCTS = ["x:main,twitter:alt,li:corp", "tt:a, threads:b,bad,nope:c", "yt_browser:one,youtube_browser:two", "x: ,ig_b:z,ig_browser:q"]
_PRIM = ["", "", "youtube_browser:two", "x:none"]


@query("fn_15_targets", """WITH d AS (SELECT doc_id, doc_id % 4 AS m FROM documents)
  SELECT doc_id, (['youtube,bluesky','instagram,youtube','ayrshare,bluesky','bluesky,youtube'])[m + 1] AS platforms,
   (['9x16,9x16,1x1','16x9','16x9,1x1',''])[m + 1] AS formats,
   (['x:main:true,x:alt:false,linkedin:corp:true','tiktok:a:true,threads:b:true',
     'youtube_browser:one:false,youtube_browser:two:true','instagram_browser:q:false'])[m + 1] AS accounts FROM d""")
def fn15(spark, sf):
    def pick(options):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (F.col("doc_id") % 4 + 1).cast("int"))

    d = t.read(spark, sf, "documents").select(
        "doc_id", pick(_LISTS).alias("p"), pick(_FMTS).alias("f"), pick(_ACCTS).alias("a"), pick(_PRIM).alias("pr"))
    accounts = F.transform(T.parse_accounts("a", "pr"), lambda r: F.concat_ws(
        ":", r["platform"], r["account"], r["is_primary"].cast("string")))
    return d.select("doc_id", F.array_join(T.parse_platforms("p"), ",").alias("platforms"),
                    F.array_join(T.parse_formats("f"), ",").alias("formats"),
                    F.array_join(accounts, ",").alias("accounts"))


@query("fn_16_media_names", r"""WITH p AS (SELECT page_id, url, url || (['.mp4','.MOV','.txt','/a.webm?x=1',''])[page_id % 5 + 1] AS u FROM pages),
  q AS (SELECT *, split_part(split_part(u, '?', 1), '/', -1) AS f, string_split('/srv/clipper/' || url, '/clipper/')[2] AS k FROM p)
  SELECT page_id, regexp_matches(lower(u), '\.(mp4|mov|mkv|webm|m4v|avi)$') AS is_video,
    CASE WHEN f <> '' THEN f END AS filename, 'clips/' || k AS object_key FROM q""")
def fn16(spark, sf):
    ext = F.element_at(F.array(*[F.lit(e) for e in (".mp4", ".MOV", ".txt", "/a.webm?x=1", "")]),
                       (F.col("page_id") % 5 + 1).cast("int"))
    p = t.read(spark, sf, "pages").withColumn("u", F.concat("url", ext))
    return p.select("page_id", T.is_video("u").alias("is_video"), T.url_filename("u").alias("filename"),
                    T.object_key(F.concat(F.lit("/srv/clipper/"), "url"), "clips").alias("object_key"))
