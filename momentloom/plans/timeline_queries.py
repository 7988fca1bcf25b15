"""INT, JN, SIG, NOV, QLT and the candidate table over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators import features as FT
from ..operators import intervals as I
from ..operators.scaling import interval_overlap, point_in_interval
from ..session import stage
from . import tables as t
from .catalog import query
from .tables import sql

P = I.WindowParams()


@query("int_01_islands", sql("""SELECT episode_id, 32 * min(frame_idx) AS start_ms, 32 * (max(frame_idx) + 1) AS end_ms FROM (
   SELECT episode_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY episode_id ORDER BY frame_idx) AS g
   FROM frames WHERE prob < 0.4) GROUP BY episode_id, g HAVING 32 * (max(frame_idx) + 1 - min(frame_idx)) >= 64""", "frames"))
def int1(spark, sf):
    return I.islands(t.frames(spark, sf), 0.4, 64, 32)


@query("int_02_invert_intervals", sql("""SELECT * FROM (
   SELECT episode_id, coalesce(max(end_ms) OVER (PARTITION BY episode_id ORDER BY start_ms
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms, start_ms AS end_ms FROM silences
   UNION ALL SELECT t.episode_id, coalesce(m, 0), total_ms FROM totals t LEFT JOIN
     (SELECT episode_id, max(end_ms) AS m FROM silences GROUP BY episode_id) s USING (episode_id))
   WHERE end_ms - start_ms >= 2000""", "totals", "silences"))
def int2(spark, sf):
    return I.invert_intervals(t.silences(spark, sf), t.totals(spark, sf), 2000)


_BOUNDS = """b AS (SELECT episode_id, start_ms AS b, start_ms * 2 AS ord FROM silences
   UNION ALL SELECT episode_id, end_ms, start_ms * 2 + 1 FROM silences)"""


@query("int_03_snap", sql("""SELECT p.episode_id, p.pos, p.t AS t_ms,
    coalesce(arg_max(b.b, (800 - abs(b.b - p.t)) * 10000000000 + ord), any_value(p.t)) AS snapped_ms
  FROM (SELECT episode_id, pos, start_ms AS t FROM words) p
  LEFT JOIN b ON b.episode_id = p.episode_id AND abs(b.b - p.t) <= 800 GROUP BY p.episode_id, p.pos, p.t""",
                          "words", "silences", extra=_BOUNDS))
def int3(spark, sf):
    pts = t.words(spark, sf).select("episode_id", "pos", F.col("start_ms").alias("t_ms"))
    return I.snap(pts, I.silence_boundaries(t.silences(spark, sf)), 800, ["pos"]).select(
        "episode_id", "pos", "t_ms", "snapped_ms")


_GRID = """grid AS (SELECT episode_id, i AS window_id, total_ms, i * 15000 AS start_ms,
    least(i * 15000 + 20000, total_ms) AS end_ms FROM (SELECT episode_id, total_ms,
    unnest(generate_series(0::BIGINT, (total_ms - 10000) // 15000)) AS i FROM totals WHERE total_ms >= 10000))"""


@query("int_04_grid", sql("SELECT * FROM grid", "totals", extra=_GRID))
def int4(spark, sf):
    return I.grid(t.totals(spark, sf), P)


_SNAPPED = _GRID + ", " + _BOUNDS + """, ends AS (SELECT episode_id, window_id, total_ms, start_ms AS a, end_ms AS z, 's' AS side, start_ms AS t FROM grid
    UNION ALL SELECT episode_id, window_id, total_ms, start_ms, end_ms, 'e', end_ms FROM grid),
  by_sil AS (SELECT n.*, coalesce((SELECT arg_max(b.b, (2000 - abs(b.b - n.t)) * 10000000000 + b.ord) FROM b
     WHERE b.episode_id = n.episode_id AND abs(b.b - n.t) <= 2000), n.t) AS v FROM ends n),
  by_shot AS (SELECT n.*, coalesce((SELECT arg_max(s.t_ms, (1000 - abs(s.t_ms - n.t)) * 10000000000 + s.t_ms) FROM shots s
     WHERE s.episode_id = n.episode_id AND abs(s.t_ms - n.t) <= 1000), n.t) AS w FROM by_sil n),
  pair AS (SELECT episode_id, window_id, total_ms, a, z, max(CASE WHEN side = 's' THEN CASE WHEN v = t THEN w ELSE v END END) AS s,
     max(CASE WHEN side = 'e' THEN CASE WHEN v = t THEN w ELSE v END END) AS e FROM by_shot GROUP BY ALL),
  c1 AS (SELECT *, least(greatest(s, 0), total_ms) AS s1 FROM pair),
  c2 AS (SELECT *, least(least(greatest(e, s1), total_ms), s1 + 30000) AS e1 FROM c1),
  win AS (SELECT episode_id, window_id, total_ms, a AS grid_start_ms, z AS grid_end_ms, s1 AS start_ms,
     greatest(e1, least(s1 + 10000, total_ms)) AS end_ms FROM c2)"""


def snapped(spark, sf):
    return I.snap_to_boundaries(I.grid(t.totals(spark, sf), P), t.boundaries(spark, sf), P)


@query("int_05_snap_windows", sql("SELECT * FROM win", "totals", "silences", "shots", extra=_SNAPPED))
def int5(spark, sf):
    return snapped(spark, sf)


_SAID = _SNAPPED + """, said AS (SELECT w.episode_id, w.window_id, w.start_ms, w.end_ms, count(d.pos) AS word_count,
    coalesce(string_agg(d.text, ' ' ORDER BY d.pos), '') AS transcript
    FROM win w LEFT JOIN words d ON d.episode_id = w.episode_id AND d.start_ms >= w.start_ms AND d.start_ms < w.end_ms
    GROUP BY ALL)"""


def windows_said(spark, sf):
    return I.packed_window_words(snapped(spark, sf), t.words(spark, sf))


def windows_counted(spark, sf):
    return I.count_words(snapped(spark, sf), t.words(spark, sf))


_KEPT = _SAID + """, ok AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY window_id) AS i FROM said
     WHERE end_ms - start_ms >= 10000 AND word_count >= 15),
   walk AS (SELECT *, start_ms AS ls, end_ms AS le, true AS keep FROM ok WHERE i = 1
     UNION ALL SELECT o.*, CASE WHEN k THEN o.start_ms ELSE w.ls END, CASE WHEN k THEN o.end_ms ELSE w.le END, k
     FROM walk w JOIN (SELECT * FROM ok) o ON o.episode_id = w.episode_id AND o.i = w.i + 1,
     LATERAL (SELECT NOT (abs(w.ls - o.start_ms) < 500 AND abs(w.le - o.end_ms) < 500) AS k))"""


def candidates(spark, sf):
    """The flagship: grid -> snap -> count -> de-duplicate -> words for every recording at once. The
    texts join the windows that are left."""
    kept = I.dedupe_windows(stage(windows_counted(spark, sf), "counted"), P)
    return I.packed_window_words(kept.drop("word_count"), t.words(spark, sf))


@query("int_06_dedupe_windows", sql("SELECT episode_id, window_id, start_ms, end_ms, word_count FROM walk WHERE keep",
                                    "words", "totals", "silences", "shots", recursive=True, extra=_KEPT))
def int6(spark, sf):
    kept = I.dedupe_windows(stage(windows_counted(spark, sf), "counted"), P)
    return kept.select("episode_id", "window_id", "start_ms", "end_ms", "word_count")


_SHIFTED = _SAID + """, twins AS (SELECT episode_id, window_id * 2 AS window_id, start_ms, end_ms, word_count FROM said
     UNION ALL SELECT episode_id, window_id * 2 + 1, start_ms + 300, end_ms + 300, word_count FROM said)""" + _KEPT[len(_SAID):].replace("FROM said", "FROM twins")


@query("int_06_dedupe_overlapping", sql("SELECT episode_id, window_id, start_ms, end_ms FROM walk WHERE keep", "words", "totals", "silences", "shots",
                                        recursive=True, extra=_SHIFTED))
def int6_overlapping(spark, sf):
    """Each window comes twice, 300 ms apart, so that one of two has to go."""
    said = windows_counted(spark, sf)
    twin = F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))
    both = said.withColumn("_k", twin).select("episode_id", (F.col("window_id") * 2 + F.col("_k")).alias("window_id"), (F.col("start_ms") + F.col("_k") * 300).alias("start_ms"),
                                              (F.col("end_ms") + F.col("_k") * 300).alias("end_ms"), "word_count")
    return I.dedupe_windows(stage(both, "counted"), P).select("episode_id", "window_id", "start_ms", "end_ms")


@query("int_07_window_words", sql("""SELECT episode_id, window_id, word_count, transcript,
   round(CASE WHEN end_ms > start_ms THEN word_count * 1000.0 / (end_ms - start_ms) END, 6) AS speaking_rate FROM said""",
                                  "words", "totals", "silences", "shots", extra=_SAID))
def int7(spark, sf):
    return windows_said(spark, sf).select("episode_id", "window_id", "word_count", "transcript",
                                          F.round("speaking_rate", 6).alias("speaking_rate"))


_HUSH = "hush AS (SELECT episode_id, start_ms - 1000 AS s, end_ms + 400 AS e FROM silences)"


@query("int_08_drop_contained", sql("""SELECT episode_id, pos FROM words w WHERE NOT EXISTS (SELECT 1 FROM hush h
   WHERE h.episode_id = w.episode_id AND w.start_ms >= h.s AND w.end_ms <= h.e)""", "words", "silences", extra=_HUSH))
def int8(spark, sf):
    hush = t.silences(spark, sf).select("episode_id", (F.col("start_ms") - 1000).alias("start_ms"),
                                        (F.col("end_ms") + 400).alias("end_ms"))
    return I.drop_contained(t.words(spark, sf), hush).select("episode_id", "pos")


@query("int_09_dedupe_by_gap", sql("""SELECT episode_id, t_ms FROM walk WHERE keep""", "ev", recursive=True, extra="""
   d AS (SELECT episode_id, t_ms, row_number() OVER (PARTITION BY episode_id ORDER BY t_ms) AS i
     FROM (SELECT DISTINCT episode_id, t_ms FROM ev)),
   walk AS (SELECT episode_id, t_ms, i, t_ms AS last, true AS keep FROM d WHERE i = 1
     UNION ALL SELECT d.episode_id, d.t_ms, d.i, CASE WHEN d.t_ms - w.last >= 14400000 THEN d.t_ms ELSE w.last END,
       d.t_ms - w.last >= 14400000 FROM walk w JOIN d ON d.episode_id = w.episode_id AND d.i = w.i + 1)"""))
def int9(spark, sf):
    return I.dedupe_by_gap(t.events(spark, sf), ["episode_id"], "t_ms", 14_400_000)


@query("int_10_overlap", sql("""SELECT g.episode_id, g.window_id, CAST(coalesce(sum(least(g.end_ms, s.end_ms) -
    greatest(g.start_ms, s.start_ms)), 0) AS BIGINT) AS overlap_ms FROM grid g LEFT JOIN speech s
    ON s.episode_id = g.episode_id AND s.start_ms < g.end_ms AND s.end_ms > g.start_ms GROUP BY ALL""",
                             "totals", "speech", extra=_GRID))
def int10(spark, sf):
    w = I.grid(t.totals(spark, sf), P).select("episode_id", "window_id", "start_ms", "end_ms")
    return I.overlap_ms(w, t.speech(spark, sf), ["window_id"]).select("episode_id", "window_id", "overlap_ms")


@query("int_11_in_any", sql("""SELECT episode_id, t_ms FROM shots t WHERE EXISTS (SELECT 1 FROM speech s
    WHERE s.episode_id = t.episode_id AND t.t_ms >= s.start_ms AND t.t_ms < s.end_ms)""", "shots", "speech"))
def int11(spark, sf):
    return I.in_any(t.shots(spark, sf), t.speech(spark, sf))


def chunks(spark, sf):
    """Turns of a conversation as chunks of one recording."""
    c = t.read(spark, sf, "conversations")
    toks = F.regexp_extract_all("text", F.lit(t.TOKEN), F.lit(1))
    return c.select(
        F.col("conv_id").alias("episode_id"), F.col("turn").alias("chunk_idx"),
        (F.col("turn") * 60_000 - 700).alias("offset_ms"), "text",
        F.transform(toks, lambda w, i: F.struct(w.alias("word"), (i * 0.25).alias("start"),
                                                (i * 0.25 + 0.125).alias("end"))).alias("words"),
        F.array(F.struct(F.lit(0.0).alias("start"), F.lit(30.0).alias("end"), F.col("text").alias("text")),
                F.struct(F.lit(30.0).alias("start"), F.lit(60.0).alias("end"), F.lit(" ").alias("text"))).alias("segments"))


@query("int_12_stitch_chunks", r"""WITH c AS (SELECT conv_id AS episode_id, turn AS chunk_idx, turn * 60000 - 700 AS o,
     text, regexp_extract_all(text, '[^ \t\n\f\r]+') AS w FROM conversations),
   x AS (SELECT episode_id, chunk_idx, o, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS pos FROM c)
   SELECT episode_id, chunk_idx, 'w' AS kind, CAST(pos AS BIGINT) AS pos, text, CAST(greatest(o + pos * 250, 0) AS BIGINT) AS start_ms,
     CAST(greatest(o + pos * 250 + 125, 0) AS BIGINT) AS end_ms FROM x
   UNION ALL SELECT episode_id, chunk_idx, 's', 0, text, o, o + 30000 FROM c WHERE NOT regexp_full_match(text, '\s*')""")
def int12(spark, sf):
    w, s = I.stitch_chunks(chunks(spark, sf))
    cols = ["episode_id", "chunk_idx", "kind", "pos", "text", "start_ms", "end_ms"]
    return (w.withColumn("kind", F.lit("w")).select(*cols)
            .unionByName(s.withColumn("kind", F.lit("s")).select(*cols)))


@query("int_13_plan_chunks", sql("""SELECT episode_id, i AS chunk_idx, i * size AS offset_ms, least(size, total_ms - i * size) AS duration_ms
   FROM (SELECT episode_id, total_ms, size, unnest(generate_series(0::BIGINT, (total_ms + size - 1) // size - 1)) AS i
   FROM (SELECT episode_id, total_ms, least(greatest(CAST(ceil(total_ms / 8000.0) AS BIGINT), 30), 120) * 1000 AS size
   FROM totals WHERE total_ms > 0))""", "totals"))
def int13(spark, sf):
    return I.plan_chunks(t.totals(spark, sf), 8, 30, 120)


_CLIPSPAN = """cs AS (SELECT episode_id, i AS clip_id, i * 37000 + 150 AS start_ms, i * 37000 + 22350 AS end_ms FROM
    (SELECT episode_id, unnest(generate_series(0::BIGINT, total_ms // 37000)) AS i FROM totals)),
  cw AS (SELECT c.episode_id, c.clip_id, w.pos, w.text, greatest(w.start_ms - c.start_ms, 0) AS start_ms,
    greatest(w.end_ms - c.start_ms, 0) AS end_ms FROM cs c JOIN words w ON w.episode_id = c.episode_id
    AND w.start_ms >= c.start_ms AND w.end_ms <= c.end_ms + 500)"""


def clip_spans(spark, sf):
    i = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("total_ms") / 37_000)))
    return t.totals(spark, sf).select("episode_id", i.alias("i")).select(
        "episode_id", F.col("i").alias("clip_id"), (F.col("i") * 37_000 + 150).alias("start_ms"),
        (F.col("i") * 37_000 + 22_350).alias("end_ms"))


@query("int_14_clip_words", sql("SELECT * FROM cw", "words", "totals", extra=_CLIPSPAN))
def int14(spark, sf):
    return I.clip_words(clip_spans(spark, sf), t.words(spark, sf))


_EDITS = """cc AS (SELECT *, episode_id || '_' || clip_id AS cid FROM cs),
  ed AS (SELECT cid, (start_ms + 1200) / 1000.0 AS a, CASE clip_id % 4 WHEN 0 THEN (start_ms + 2700) / 1000.0
     WHEN 1 THEN (start_ms + 9200) / 1000.0 WHEN 2 THEN (start_ms + 401200) / 1000.0
     ELSE (start_ms + 15200) / 1000.0 END AS b FROM cc),
  chk AS (SELECT *, round(greatest(a, 0) * 1000)::BIGINT AS na, round(b * 1000)::BIGINT AS nb FROM ed JOIN cc USING (cid)),
  res AS (SELECT *, CASE WHEN nb - na < 3000 THEN 'duration ' || printf('%.1f', (nb - na) / 1000) || 's below 3s minimum'
     WHEN nb - na > 300000 THEN 'duration ' || printf('%.1f', (nb - na) / 1000) || 's above 300s maximum' END AS reason FROM chk)"""


def recut_all(spark, sf):
    spans = stage(clip_spans(spark, sf), "spans")
    cid = F.concat_ws("_", "episode_id", "clip_id")
    words = I.clip_words(spans.hint("merge"), t.words(spark, sf)).withColumn("clip_id", cid)
    s, n = F.col("start_ms"), F.col("clip_id") % 4
    edits = spans.select(cid.alias("clip_id"), ((s + 1200) / 1000).alias("new_start_s"), (
        F.when(n == 0, s + 2700).when(n == 1, s + 9200).when(n == 2, s + 401_200).otherwise(s + 15_200) / 1000)
        .alias("new_end_s"))
    return I.recut(spans.withColumn("clip_id", cid), edits, words)


@query("int_15_recut", sql("""SELECT cid AS clip_id, 'bad' AS kind, reason AS text, NULL::BIGINT AS pos, NULL::BIGINT AS start_ms,
     NULL::BIGINT AS end_ms FROM res WHERE reason IS NOT NULL
   UNION ALL SELECT cid, 'bounds', NULL, NULL, na, nb FROM res WHERE reason IS NULL
   UNION ALL SELECT r.cid, 'word', w.text, w.pos, greatest(w.start_ms - o, 0), greatest(w.end_ms - o, 0)
     FROM (SELECT *, greatest(na - start_ms, 0) AS o FROM res WHERE reason IS NULL) r JOIN cw w
     ON w.episode_id = r.episode_id AND w.clip_id = r.clip_id AND w.start_ms >= o - 1 AND w.end_ms <= o + nb - na + 500""",
                           "words", "totals", extra=_CLIPSPAN + ", " + _EDITS))
def int15(spark, sf):
    bounds, words, bad = recut_all(spark, sf)
    none = F.lit(None)
    cols = ["clip_id", "kind", "text", "pos", "start_ms", "end_ms"]
    return (bad.select("clip_id", F.lit("bad").alias("kind"), F.col("reason").alias("text"),
                       *[none.cast("bigint").alias(c) for c in cols[3:]])
            .unionByName(bounds.select("clip_id", F.lit("bounds").alias("kind"), none.cast("string").alias("text"),
                                       none.cast("bigint").alias("pos"), "start_ms", "end_ms"))
            .unionByName(words.select("clip_id", F.lit("word").alias("kind"), "text", "pos", "start_ms", "end_ms")))


@query("int_16_synth_segments", r"""WITH c AS (SELECT doc_id AS episode_id, text, regexp_extract_all(text, '\S+') AS w,
     CASE WHEN doc_id % 5 = 0 THEN 60000 ELSE (doc_id % 5) * 70000 END AS d FROM documents),
   m AS (SELECT *, len(w) AS n, CASE WHEN len(w) = 0 THEN 1 ELSE greatest((d + 59999) // 60000, 1) END AS k FROM c),
   r AS (SELECT *, unnest(generate_series(0::BIGINT, k - 1)) AS i FROM m)
   SELECT episode_id, i AS minute, CAST(CASE WHEN n = 0 THEN 5000 ELSE 5000 + i * 60000 END AS BIGINT) AS start_ms,
     CAST(CASE WHEN n = 0 THEN 5000 + d ELSE least(65000 + i * 60000, 5000 + d) END AS BIGINT) AS end_ms,
     CASE WHEN n = 0 THEN text ELSE coalesce(list_aggregate(list_slice(w, i * n // k + 1,
        least(greatest((i + 1) * n // k, i * n // k + 1), n)), 'string_agg', ' '), '') END AS text FROM r""")
def int16(spark, sf):
    d = t.docs(spark, sf).select("episode_id", F.lit(0).cast("bigint").alias("chunk_idx"),
                                 F.lit(5_000).cast("bigint").alias("offset_ms"), "text",
                                 ((F.col("episode_id") % 5) * 70_000).alias("duration_ms"))
    return I.synth_segments(d).drop("chunk_idx")


_SEGS = r"""segs AS (SELECT episode_id, pos // 6 AS ord, (pos // 6) * 2400 * 2 AS start_ms,
    string_agg(text, ' ' ORDER BY pos) AS text FROM words GROUP BY ALL)"""


def six_word_segments(spark, sf):
    """Cut in the row that holds the words, so no word moves."""
    n = F.size("_ws")
    cuts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 6).cast("int")), lambda i: F.array_join(F.slice("_ws", i * 6 + 1, F.lit(6)), " ")))
    return (t.word_lists(spark, sf).select("episode_id", F.posexplode(cuts).alias("ord", "text"))
            .select("episode_id", F.col("ord").cast("bigint").alias("ord"), "text", (F.col("ord") * 4_800).cast("bigint").alias("start_ms")))


@query("int_17_minute_index", sql(r"""SELECT episode_id, minute, CASE WHEN length(tx) <= 600 THEN tx ELSE tx[1:600] END AS text FROM (
   SELECT episode_id, minute, string_agg(piece, '' ORDER BY ord) AS tx, row_number() OVER (PARTITION BY episode_id ORDER BY minute) AS rn
   FROM (SELECT *, coalesce(sum(strlen(piece)) OVER (PARTITION BY episode_id, minute ORDER BY ord
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
     FROM (SELECT episode_id, ord, start_ms // 60000 AS minute, text || ' ' AS piece FROM segs))
   WHERE b < 800 GROUP BY episode_id, minute) WHERE rn <= 180""", "words", extra=_SEGS))
def int17(spark, sf):
    return I.minute_index(six_word_segments(spark, sf))


@query("int_18_sample_times", sql("""SELECT id AS clip_id, 'mid' AS mode, i AS sample_idx, round(start_ms + (i + 0.5) * d / n, 3) AS t_ms FROM (
     SELECT *, unnest(generate_series(0::BIGINT, n - 1)) AS i FROM (SELECT *, CAST(greatest(round(d / 1000 * 0.5), 1) AS BIGINT) AS n
       FROM (SELECT *, CAST(end_ms - start_ms AS DOUBLE) AS d FROM clips) WHERE d > 0))
   UNION ALL SELECT id, 'interior', i, round(start_ms + (i + 1) * d / 5, 3) FROM (SELECT *, unnest(generate_series(0::BIGINT, 3)) AS i
     FROM (SELECT *, CAST(end_ms - start_ms AS DOUBLE) AS d FROM clips) WHERE d > 0)""", "clips"))
def int18(spark, sf):
    c = t.clips(spark, sf).select(F.col("id").alias("clip_id"), "start_ms", "end_ms")
    out = [I.sample_times(c, fps=0.5).withColumn("mode", F.lit("mid")),
           I.sample_times(c, n=4, mode="interior").withColumn("mode", F.lit("interior"))]
    return out[0].unionByName(out[1]).select("clip_id", "mode", "sample_idx", F.round("t_ms", 3).alias("t_ms"))


@query("int_19_repair_moments", sql("""SELECT episode_id, slot, t AS t_ms, reason FROM (SELECT w.episode_id, w.t,
     row_number() OVER (PARTITION BY w.episode_id ORDER BY w.t) AS slot FROM walk w WHERE keep) JOIN named USING (episode_id, t) WHERE slot <= 24""",
                                    "ev", recursive=True, extra="""
   given AS (SELECT episode_id, event_id AS pos, CASE WHEN event_id % 9 = 0 OR value - 2 < 0 THEN 0 ELSE CAST(round((value - 2) * 1000) AS BIGINT) END AS t,
     CASE WHEN event_id % 4 = 0 THEN 'thumbnail moment' ELSE 'laugh' END AS reason FROM ev WHERE event_type = 'error'),
   ext AS (SELECT episode_id, greatest(max(CAST(floor(value * 1000) AS BIGINT)) - 250, 0) AS last FROM ev GROUP BY ALL),
   short AS (SELECT e.episode_id, last, coalesce(n, 0) AS have FROM ext e LEFT JOIN (SELECT episode_id, count(*) AS n FROM given GROUP BY ALL) g
     ON g.episode_id = e.episode_id WHERE coalesce(n, 0) < 24),
   pads AS (SELECT episode_id, have + i AS pos, CAST(trunc(least((have + 2 * i) * (last / 23), last)) AS BIGINT) AS t, 'big reaction — safe filler' AS reason
     FROM (SELECT *, unnest(generate_series(0::BIGINT, 24 - have - 1)) AS i FROM short)),
   every_one AS (SELECT * FROM given UNION ALL SELECT * FROM pads),
   named AS (SELECT episode_id, t, arg_min(reason, pos) AS reason FROM every_one GROUP BY ALL),
   d AS (SELECT episode_id, t, row_number() OVER (PARTITION BY episode_id ORDER BY t) AS i FROM named),
   walk AS (SELECT episode_id, t, i, t AS last, true AS keep FROM d WHERE i = 1
     UNION ALL SELECT d.episode_id, d.t, d.i, CASE WHEN d.t - w.last >= 250 THEN d.t ELSE w.last END, d.t - w.last >= 250
       FROM walk w JOIN d ON d.episode_id = w.episode_id AND d.i = w.i + 1)"""))
def int19(spark, sf):
    ev = t.events(spark, sf).filter(F.col("event_type") == "error")
    moments = ev.select("episode_id", F.col("event_id").alias("pos"),
                        F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 2).alias("center_s"),
                        F.when(F.col("event_id") % 4 == 0, F.lit(" ")).otherwise(F.lit("laugh")).alias("reason"))
    segs = t.events(spark, sf).select("episode_id", F.lit(0).cast("bigint").alias("start_ms"),
                                      F.floor(F.col("value") * 1000).alias("end_ms"))
    out = I.repair_moments(moments, segs, 24)
    return out.select("episode_id", F.col("slot").cast("bigint").alias("slot"), "t_ms", "reason")


# -- SIG, NOV, QLT --------------------------------------------------------------------

DAY_BUCKET = 21_600_000


@query("sig_01_rms", sql("""SELECT w.episode_id, window_id, round(max(value), 6) AS rms_peak_db, round(avg(value), 6) AS rms_mean_db
  FROM evwin w JOIN ev e ON e.episode_id = w.episode_id AND t_ms >= start_ms AND t_ms < end_ms AND event_type = 'view'
  GROUP BY ALL""", "ev", "evwin"))
def sig1(spark, sf):
    r = FT.rms_features(t.event_windows(spark, sf), t.curve(spark, sf, "view", "rms_db"), DAY_BUCKET)
    return r.select("episode_id", "window_id", *[F.round(c, 6).alias(c) for c in ("rms_peak_db", "rms_mean_db")])


@query("sig_02_f0", sql("""SELECT w.episode_id, window_id, round(avg(value), 6) AS f0_mean_hz, round(var_pop(value), 4) AS f0_variance_hz2,
  round(max(value), 6) AS f0_peak_hz FROM evwin w JOIN ev e ON e.episode_id = w.episode_id AND t_ms >= start_ms
  AND t_ms < end_ms AND event_type = 'click' AND value > 0 GROUP BY ALL""", "ev", "evwin"))
def sig2(spark, sf):
    r = FT.f0_features(t.event_windows(spark, sf), t.curve(spark, sf, "click", "pitch_hz"), DAY_BUCKET)
    return r.select("episode_id", "window_id", F.round("f0_mean_hz", 6).alias("f0_mean_hz"),
                    F.round("f0_variance_hz2", 4).alias("f0_variance_hz2"), F.round("f0_peak_hz", 6).alias("f0_peak_hz"))


@query("sig_03_audio_events", sql("""SELECT w.episode_id, window_id, round(avg(laughter), 6) AS laughter, round(avg(applause), 6) AS applause,
  round(avg(music), 6) AS music, round(avg(speech), 6) AS speech FROM evwin w JOIN spans s ON s.episode_id = w.episode_id
  AND s.start_ms < w.end_ms AND s.end_ms > w.start_ms GROUP BY ALL""", "evwin", "spans"))
def sig3(spark, sf):
    r = FT.event_features(t.event_windows(spark, sf), t.audio_spans(spark, sf), DAY_BUCKET)
    return r.select("episode_id", "window_id", *[F.round(c, 6).alias(c) for c in FT.AUDIO_CLASSES])


_SETS = {"speech": [0, 1, 2, 3, 4, 5], "laughter": [13], "applause": [36], "music": [137]}


@query("sig_04_class_groups", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings)
  SELECT vec_id, round(list_max(e[1:6]) / list_sum(e), 6) AS speech, round(e[14] / list_sum(e), 6) AS laughter,
   round(e[37] / list_sum(e), 6) AS applause, 0.0::DOUBLE AS music FROM e""")
def sig4(spark, sf):
    e = t.read(spark, sf, "embeddings").select("vec_id", FT.class_groups("embedding", _SETS).alias("g"))
    return e.select("vec_id", *[F.round(F.col(f"g.{c}"), 6).alias(c) for c in ("speech", "laughter", "applause", "music")])


@query("sig_05_speaking_rate", sql("""SELECT g.episode_id, g.window_id, round(count(w.pos) * 1000.0 / (g.end_ms - g.start_ms), 6) AS wps
  FROM grid g LEFT JOIN words w ON w.episode_id = g.episode_id AND w.start_ms >= g.start_ms AND w.start_ms < g.end_ms
  GROUP BY g.episode_id, g.window_id, g.start_ms, g.end_ms""", "words", "totals", extra=_GRID))
def sig5(spark, sf):
    w = I.packed_window_words(I.grid(t.totals(spark, sf), P), t.words(spark, sf))
    return w.select("episode_id", "window_id", F.round("speaking_rate", 6).alias("wps"))


_NOVELTY = """m AS (SELECT episode_id, list(x ORDER BY i) AS c FROM (SELECT episode_id, i, avg(x) AS x FROM
     (SELECT episode_id, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY ALL) GROUP BY ALL),
   d AS (SELECT episode_id, window_id, 1 - list_cosine_similarity(v::DOUBLE[], c) AS d FROM vectors JOIN m USING (episode_id))"""


def signal_vectors(spark, sf):
    """A vector per event window: how often each kind of event lies in it."""
    ev = t.events(spark, sf).select("episode_id", F.col("t_ms").alias("_t"), "event_type")
    hit = point_in_interval(t.event_windows(spark, sf), ev, ["episode_id"], "start_ms", "end_ms", "_t", DAY_BUCKET, "left")
    kinds = [F.count_if(F.col("event_type") == k).cast("double") for k in ("view", "click", "error")]
    return hit.groupBy(*FT.SPAN).agg(F.array(*kinds, F.lit(1.0)).alias("v"))


def wide_candidates(spark, sf, novelty=None):
    """SIG-6 on the event timelines: every signal attached to every window."""
    spans = t.event_windows(spark, sf)
    said = t.events(spark, sf).select("episode_id", F.col("event_id").alias("pos"), F.col("event_type").alias("text"),
                                      F.col("t_ms").alias("start_ms"))
    w = I.window_words(spans, said, width=DAY_BUCKET, joiner=". ")
    return FT.build_candidates(w, t.curve(spark, sf, "view", "rms_db"), t.curve(spark, sf, "click", "pitch_hz"),
                               novelty, t.audio_spans(spark, sf), DAY_BUCKET, spans)


@query("sig_06_candidates", sql("""SELECT w.episode_id, w.window_id,
   (SELECT count(*) FROM ev e WHERE e.episode_id = w.episode_id AND e.t_ms >= w.start_ms AND e.t_ms < w.end_ms) AS word_count,
   round((SELECT max(value) FROM ev e WHERE e.episode_id = w.episode_id AND e.t_ms >= w.start_ms AND e.t_ms < w.end_ms AND event_type = 'view'), 6) AS rms_peak_db,
   round((SELECT avg(value) FROM ev e WHERE e.episode_id = w.episode_id AND e.t_ms >= w.start_ms AND e.t_ms < w.end_ms AND event_type = 'click' AND value > 0), 6) AS f0_mean_hz,
   round((SELECT avg(s.music) FROM spans s WHERE s.episode_id = w.episode_id AND s.start_ms < w.end_ms AND s.end_ms > w.start_ms), 6) AS music,
   CAST((SELECT count(*) FROM ev e WHERE e.episode_id = w.episode_id AND e.t_ms >= w.start_ms AND e.t_ms < w.end_ms) AS BIGINT) AS sentence_count
   FROM evwin w""", "ev", "evwin", "spans"))
def sig6(spark, sf):
    c = wide_candidates(spark, sf)
    return c.select("episode_id", "window_id", "word_count", F.round("rms_peak_db", 6).alias("rms_peak_db"),
                    F.round("f0_mean_hz", 6).alias("f0_mean_hz"), F.round("audio_events.music", 6).alias("music"),
                    F.col("linguistic.sentence_count").alias("sentence_count"))


_INSIDE = "FROM ev e WHERE e.episode_id = w.episode_id AND e.t_ms >= w.start_ms AND e.t_ms < w.end_ms"
_HEARD = "FROM spans s WHERE s.episode_id = w.episode_id AND s.start_ms < w.end_ms AND s.end_ms > w.start_ms"
_COUNTS = f"""vectors AS (SELECT episode_id, window_id, [(SELECT count(*) {_INSIDE} AND event_type = 'view'), (SELECT count(*) {_INSIDE} AND event_type = 'click'),
     (SELECT count(*) {_INSIDE} AND event_type = 'error'), 1]::DOUBLE[] AS v FROM evwin w)"""


@query("sig_06_all_signals", sql(f"""SELECT w.episode_id, w.window_id, w.start_ms, w.end_ms,
   (SELECT count(*) {_INSIDE}) AS word_count, (SELECT coalesce(string_agg(event_type, '. ' ORDER BY t_ms, event_id), '') {_INSIDE}) AS transcript,
   round((SELECT count(*) * 1000 / (w.end_ms - w.start_ms) {_INSIDE}), 6) AS speaking_rate,
   round((SELECT max(value) {_INSIDE} AND event_type = 'view'), 6) AS rms_peak_db, round((SELECT avg(value) {_INSIDE} AND event_type = 'view'), 6) AS rms_mean_db,
   round((SELECT avg(value) {_INSIDE} AND event_type = 'click' AND value > 0), 6) AS f0_mean_hz, round((SELECT var_pop(value) {_INSIDE} AND event_type = 'click' AND value > 0), 4) AS f0_variance_hz2,
   round((SELECT max(value) {_INSIDE} AND event_type = 'click' AND value > 0), 6) AS f0_peak_hz,
   round((SELECT avg(s.laughter) {_HEARD}), 6) AS laughter, round((SELECT avg(s.applause) {_HEARD}), 6) AS applause,
   round((SELECT avg(s.music) {_HEARD}), 6) AS music, round((SELECT avg(s.speech) {_HEARD}), 6) AS speech,
   n.novelty, CAST((SELECT count(*) {_INSIDE}) AS BIGINT) AS sentence_count, 0::BIGINT AS questions
   FROM evwin w JOIN (SELECT episode_id, window_id, round((d - min(d) OVER x) / greatest(max(d) OVER x - min(d) OVER x, 1e-9), 4) AS novelty FROM d WINDOW x AS (PARTITION BY episode_id)) n
     ON n.episode_id = w.episode_id AND n.window_id = w.window_id""", "ev", "evwin", "spans", extra=_COUNTS + ", " + _NOVELTY))
def sig6_all(spark, sf):
    """Every column, novelty among them."""
    c = wide_candidates(spark, sf, FT.novelty(signal_vectors(spark, sf)))
    plain = ["speaking_rate", "rms_peak_db", "rms_mean_db", "f0_mean_hz", "f0_peak_hz"]
    return c.select("episode_id", "window_id", "start_ms", "end_ms", "word_count", "transcript", *[F.round(k, 6).alias(k) for k in plain],
                    F.round("f0_variance_hz2", 4).alias("f0_variance_hz2"), *[F.round(F.col(f"audio_events.{k}"), 6).alias(k) for k in FT.AUDIO_CLASSES],
                    F.round("novelty", 4).alias("novelty"), F.col("linguistic.sentence_count").alias("sentence_count"),
                    F.col("linguistic.questions").cast("bigint").alias("questions"))


@query("nov_01_cosine", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cos
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def nov1(spark, sf):
    e = t.read(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(FT.cosine("embedding", "b"), 5).alias("cos"))


@query("nov_02_mean_vector", sql("SELECT episode_id, generate_subscripts(c, 1) - 1 AS i, round(unnest(c), 6) AS x FROM m",
                                 "vectors", extra=_NOVELTY))
def nov2(spark, sf):
    m = FT.mean_vector(t.vectors(spark, sf), ["episode_id"])
    return m.select("episode_id", F.posexplode("mean").alias("i", "x")).select(
        "episode_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query("nov_03_novelty", sql("""SELECT episode_id, window_id, round((d - min(d) OVER w) / greatest(max(d) OVER w - min(d) OVER w, 1e-9), 5) AS novelty
   FROM d WINDOW w AS (PARTITION BY episode_id)""", "vectors", extra=_NOVELTY))
def nov3(spark, sf):
    return FT.novelty(t.vectors(spark, sf)).select("episode_id", "window_id", F.round("novelty", 5).alias("novelty"))


@query("nov_04_embed", """SELECT doc_id AS episode_id, 64 AS dim, CASE WHEN regexp_matches(text, '\\S') THEN 1.0::DOUBLE ELSE 0.0 END AS norm2 FROM documents""")
def nov4(spark, sf):
    e = FT.embed(t.docs(spark, sf), "text", dim=64)
    return e.select("episode_id", F.size("v").alias("dim"),
                    F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))


_LEADS = ["", "สวัสดี ", "again and again and again and again and again and again ", ""]


QLT1 = rf"""WITH c AS (SELECT doc_id AS episode_id, (['{"','".join(_LEADS)}'])[doc_id % 4 + 1] || text AS text,
     CASE WHEN doc_id % 6 = 3 THEN 1000000.0 ELSE 5.0 END AS d FROM documents),
  k AS (SELECT *, regexp_extract_all(lower(text), '\S+') AS w FROM c),
  g AS (SELECT episode_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS gram
        FROM k WHERE len(w) >= 6),
  m AS (SELECT episode_id, max(n) AS best FROM (SELECT episode_id, gram, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL)
  SELECT k.episode_id, CASE WHEN contains(text, 'สวัสดี') THEN 'foreign-script' WHEN coalesce(best, 0) > 3 THEN 'repeated-3-gram'
    WHEN d > 5 AND len(w) > 0 AND len(w) / d < 0.5 THEN 'density' END AS reason FROM k LEFT JOIN m USING (episode_id)"""


@query("qlt_01_flag_chunks", QLT1)
def qlt1(spark, sf):
    return FT.flag_chunks(doc_chunks(spark, sf)).select("episode_id", "reason")


def doc_chunks(spark, sf):
    return qlt1_chunks(t.docs(spark, sf))


def qlt1_chunks(docs):
    """Each document as one chunk behind a lead that may trip the gate."""
    lead = F.element_at(F.array(*[F.lit(s) for s in _LEADS]), (F.col("episode_id") % 4 + 1).cast("int"))
    return docs.withColumn("text", F.concat(lead, F.col("text"))).select(
        "episode_id", F.lit(0).cast("bigint").alias("chunk_idx"), "text", word_count("text").alias("n_words"),
        F.when(F.col("episode_id") % 6 == 3, 1_000_000.0).otherwise(5.0).alias("duration_s"))


@query("jn_02_interval_overlap", sql("""SELECT w.episode_id, w.window_id, s.start_ms AS span_start_ms FROM evwin w JOIN spans s
   ON s.episode_id = w.episode_id AND s.start_ms < w.end_ms AND s.end_ms > w.start_ms""", "evwin", "spans"))
def jn2(spark, sf):
    s = t.audio_spans(spark, sf).select("episode_id", F.col("start_ms").alias("span_start_ms"), F.col("end_ms").alias("_e"))
    return interval_overlap(t.event_windows(spark, sf), s, ["episode_id"], "start_ms", "end_ms", "span_start_ms", "_e",
                            DAY_BUCKET).select("episode_id", "window_id", "span_start_ms")


@query("candidate_windows", sql("""SELECT episode_id, window_id, start_ms, end_ms, word_count, transcript,
    CAST(len(list_filter(regexp_split_to_array(transcript, '[.!?]+(?:\\s+|$)'), lambda s: s <> '')) AS BIGINT) AS sentence_count
    FROM walk WHERE keep""", "words", "totals", "silences", "shots", recursive=True, extra=_KEPT))
def candidate_windows(spark, sf):
    """Flagship: candidate windows with words and text features for every recording."""
    c = FT.build_candidates(candidates(spark, sf))
    return c.select("episode_id", "window_id", "start_ms", "end_ms", "word_count", "transcript", "linguistic.sentence_count")
