"""TRK-1..10 and CAP-1..3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import captions as C
from ..operators import intervals as I
from ..operators import tracking as K
from ..session import stage
from . import tables as t
from .catalog import query
from .tables import sql
from .timeline_queries import _CLIPSPAN, clip_spans

CLIP = K.CLIP


def detections(spark, sf):
    return boxes_of(t.read(spark, sf, "lineitem"))


def boxes_of(lines):
    """Boxes from the order lines: an order is a clip, a line number a frame."""
    k = F.col
    x, y, s = (k("l_partkey") % 60).cast("double"), (k("l_suppkey") % 40).cast("double"), k("l_quantity") + 30
    return lines.select(
        k("l_orderkey").alias("episode_id"), k("l_orderkey").alias("clip_id"), k("l_linenumber").cast("bigint").alias("frame_idx"),
        (k("l_linenumber") * 250).cast("bigint").alias("t_ms"),
        (k("l_partkey") * 1_000_000 + k("l_suppkey") * 1000 + k("l_quantity").cast("bigint")).alias("det_idx"),
        x.alias("x1"), y.alias("y1"), (x + s).alias("x2"), (y + s).alias("y2"), (k("l_quantity") / 50).alias("conf"))


def order_speech(spark, sf):
    """Two spoken stretches per order."""
    o = t.read(spark, sf, "orders")
    a = (F.col("o_custkey") % 700).cast("bigint")
    return o.select(F.col("o_orderkey").alias("episode_id"), F.explode(F.array(
        F.struct(a.alias("s"), (a + 400).alias("e")), F.struct((a + 900).alias("s"), (a + 1300).alias("e")))).alias("v")).select(
        "episode_id", F.col("v.s").alias("start_ms"), F.col("v.e").alias("end_ms"))


_DETS = """dets AS (SELECT l_orderkey AS clip_id, CAST(l_linenumber AS BIGINT) AS frame_idx, l_linenumber * 250 AS t_ms,
   l_partkey * 1000000 + l_suppkey * 1000 + CAST(trunc(l_quantity) AS BIGINT) AS det_idx, (l_partkey % 60)::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE AS y1,
   l_partkey % 60 + l_quantity + 30 AS x2, l_suppkey % 40 + l_quantity + 30 AS y2, l_quantity / 50 AS conf FROM lineitem),
 sp AS (SELECT o_orderkey AS clip_id, unnest([o_custkey % 700, o_custkey % 700 + 900]) AS s FROM orders)"""


@query("trk_01_iou", sql("""SELECT d.clip_id, det_idx, frame_idx, round(CASE WHEN u <= 0 THEN 0 ELSE i / u END, 6) AS iou FROM (
   SELECT *, greatest(least(x2, 80) - greatest(x1, 20), 0) * greatest(least(y2, 70) - greatest(y1, 10), 0) AS i,
     (x2 - x1) * (y2 - y1) + 60 * 60 - greatest(least(x2, 80) - greatest(x1, 20), 0) * greatest(least(y2, 70) - greatest(y1, 10), 0) AS u FROM dets) d""", extra=_DETS))
def trk1(spark, sf):
    d = detections(spark, sf)
    ref = [F.lit(float(v)) for v in (20, 10, 80, 70)]
    return d.select("clip_id", "det_idx", "frame_idx", F.round(K.iou([F.col(c) for c in K.BOX], ref), 6).alias("iou"))


_IOU = """(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))
   / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
      - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"""
_NMS = _DETS + """, n AS (SELECT clip_id, frame_idx, det_idx, conf, {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} AS a,
     row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY conf DESC, det_idx) AS i FROM dets),
   walk AS (SELECT clip_id, frame_idx, det_idx, conf, i, [a] AS kept, true AS keep FROM n WHERE i = 1
     UNION ALL SELECT n.clip_id, n.frame_idx, n.det_idx, n.conf, n.i, CASE WHEN c = 0 THEN list_append(w.kept, n.a) ELSE w.kept END, c = 0
     FROM walk w JOIN n ON n.clip_id = w.clip_id AND n.frame_idx = w.frame_idx AND n.i = w.i + 1,
     LATERAL (SELECT len(list_filter(w.kept, lambda b: """ + _IOU.replace("a.", "n.a.").replace("n.a.x1", "n.a.x1") + """ > 0.3)) AS c))"""


@query("trk_02_nms", "WITH RECURSIVE " + _NMS + " SELECT clip_id, frame_idx, det_idx, conf FROM walk WHERE keep")
def trk2(spark, sf):
    return K.nms(detections(spark, sf), 0.3).select("clip_id", "frame_idx", "det_idx", "conf")


# Overlap tracking frame by frame: pairs of the last frame's boxes (i) and this one's (j), best
# first, are taken while both are free; boxes left over begin tracks in their order.
_TRACK_IOU = _DETS + """, f AS (SELECT clip_id, frame_idx, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS n, boxes FROM (
     SELECT clip_id, frame_idx, list({'id': 0::BIGINT, 'det': det_idx, 'x1': x1, 'y1': y1, 'x2': x2::DOUBLE, 'y2': y2::DOUBLE} ORDER BY det_idx) AS boxes FROM dets GROUP BY ALL)),
   walk AS (SELECT clip_id, frame_idx, n, len(boxes)::BIGINT AS fresh, list_transform(boxes, lambda b, k: {'id': (k - 1)::BIGINT, 'det': b.det, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}) AS cur
     FROM f WHERE n = 1
     UNION ALL SELECT clip_id, frame_idx, n, fresh + len(rest), list_concat(
       list_transform(m, lambda q: {'id': prev[q.i].id, 'det': boxes[q.j].det, 'x1': boxes[q.j].x1, 'y1': boxes[q.j].y1, 'x2': boxes[q.j].x2, 'y2': boxes[q.j].y2}),
       list_transform(rest, lambda b, k: {'id': fresh + k - 1, 'det': b.det, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}))
     FROM (SELECT *, list_filter(boxes, lambda b, k: NOT list_contains(list_transform(m, lambda q: q.j), k)) AS rest
     FROM (SELECT *, list_reduce(list_prepend({'s': 0::DOUBLE, 'i': 0::BIGINT, 'j': 0::BIGINT, 'm': []::STRUCT(i BIGINT, j BIGINT)[]}, list_sort(list_filter(flatten(
           list_transform(prev, lambda a, i: list_transform(boxes, lambda b, j: {'s': -(""" + _IOU + """)::DOUBLE, 'i': i::BIGINT, 'j': j::BIGINT, 'm': []::STRUCT(i BIGINT, j BIGINT)[]}))),
         lambda c: c.s <= -0.3))), lambda t, c: CASE WHEN list_contains(list_transform(t.m, lambda q: q.i), c.i) OR list_contains(list_transform(t.m, lambda q: q.j), c.j) THEN t
           ELSE {'s': c.s, 'i': c.i, 'j': c.j, 'm': list_append(t.m, {'i': c.i, 'j': c.j})} END).m AS m
     FROM (SELECT f.*, w.fresh, CASE WHEN f.frame_idx = w.frame_idx + 1 THEN w.cur ELSE [] END AS prev FROM walk w JOIN f ON f.clip_id = w.clip_id AND f.n = w.n + 1))))
   SELECT clip_id, frame_idx, cur[k].det AS det_idx, cur[k].id AS track_id, (k - 1)::BIGINT AS out_idx FROM walk, LATERAL (SELECT unnest(range(1, len(cur) + 1)) AS k)"""


@query("trk_03_track_iou", "WITH RECURSIVE " + _TRACK_IOU)
def trk3(spark, sf):
    return K.track_iou(detections(spark, sf), 0.3).select("clip_id", "frame_idx", "det_idx", "track_id", "out_idx")


# Nearest-centre tracking box by box: faces of the frame before, faces of this frame, next id.
TRACK_NN = _DETS + """, o AS (SELECT clip_id, frame_idx, det_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
     row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx, conf DESC, det_idx) AS i FROM dets),
   walk AS (SELECT clip_id, frame_idx, det_idx, i, 0::BIGINT AS id, 1::BIGINT AS fresh, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] AS prev,
       [{'id': 0::BIGINT, 'x': cx, 'y': cy}] AS cur FROM o WHERE i = 1
     UNION ALL SELECT clip_id, frame_idx, det_idx, i, coalesce(hit, fresh), CASE WHEN hit IS NULL THEN fresh + 1 ELSE fresh END, prev,
       list_append(cur, {'id': coalesce(hit, fresh), 'x': cx, 'y': cy})
     FROM (SELECT *, (list_sort(list_transform(list_filter(list_transform(prev, lambda p, j: {'d': sqrt((cx - p.x) * (cx - p.x) + (cy - p.y) * (cy - p.y)), 'j': j, 'id': p.id}),
         lambda c: c.d <= 25 AND NOT list_contains(list_transform(cur, lambda q: q.id), c.id)), lambda c: c)))[1].id AS hit
       FROM (SELECT o.*, w.fresh, CASE WHEN o.frame_idx = w.frame_idx THEN w.prev WHEN o.frame_idx = w.frame_idx + 1 THEN w.cur ELSE [] END AS prev,
         CASE WHEN o.frame_idx = w.frame_idx THEN w.cur ELSE [] END AS cur FROM walk w JOIN o ON o.clip_id = w.clip_id AND o.i = w.i + 1)))
   SELECT clip_id, frame_idx, det_idx, id AS track_id FROM walk"""


@query("trk_04_track_nn", "WITH RECURSIVE " + TRACK_NN)
def trk4(spark, sf):
    return K.track_nn(detections(spark, sf), 25.0).select("clip_id", "frame_idx", "det_idx", "track_id")


def thirds(spark, sf):
    """Tracks by a rule SQL can repeat: the box's horizontal third."""
    return detections(spark, sf).withColumn("track_id", F.floor(F.col("x1") / 20))


_SCORES = _DETS + """, pres AS (SELECT DISTINCT clip_id, floor(x1 / 20) AS track_id, t_ms FROM dets),
   sc AS (SELECT p.clip_id, p.track_id, count(DISTINCT t_ms) * 250.0 AS presence_ms, coalesce(sum(greatest(least(t_ms + 250, s + 400) - greatest(t_ms, s), 0)), 0)::DOUBLE AS overlap_ms
     FROM pres p LEFT JOIN sp ON sp.clip_id = p.clip_id GROUP BY ALL)"""


@query("trk_05_speech_scores", sql("""SELECT clip_id, track_id::BIGINT AS track_id, presence_ms::DOUBLE AS presence_ms, overlap_ms,
   round(least(greatest(overlap_ms / presence_ms, 0), 1), 6) AS ratio FROM sc""", extra=_SCORES))
def trk5(spark, sf):
    s = K.speech_scores(thirds(spark, sf), order_speech(spark, sf), 4.0)
    return s.select("clip_id", "track_id", "presence_ms", "overlap_ms", F.round("ratio", 6).alias("ratio"))


@query("trk_06_elect_speaker", sql("""SELECT f.clip_id, f.frame_idx, w.track_id::BIGINT AS track_id, w.x1 FROM (SELECT DISTINCT clip_id, frame_idx, t_ms FROM dets) f LEFT JOIN (
   SELECT d.clip_id, d.frame_idx, sc.track_id, x1, row_number() OVER (PARTITION BY d.clip_id, d.frame_idx ORDER BY round(least(overlap_ms / presence_ms, 1), 9) DESC, conf DESC, det_idx DESC) AS rn
   FROM dets d JOIN sc ON sc.clip_id = d.clip_id AND sc.track_id = floor(d.x1 / 20) AND overlap_ms > 0
   WHERE EXISTS (SELECT 1 FROM sp WHERE sp.clip_id = d.clip_id AND d.t_ms >= s AND d.t_ms < s + 400)) w
   ON w.clip_id = f.clip_id AND w.frame_idx = f.frame_idx AND rn = 1""", extra=_SCORES))
def trk6(spark, sf):
    tr = thirds(spark, sf)
    e = K.elect_speaker(tr, K.speech_scores(tr, order_speech(spark, sf), 4.0), order_speech(spark, sf))
    return e.select("clip_id", "frame_idx", "track_id", "x1")


def hold_sql(el: str) -> str:
    """The hold rule as SQL sees it: walk the frames of a clip (``el``: clip_id, frame_idx from 1,
    win) in order; a challenger needs three frames in a row."""
    return f"""walk_hold AS (SELECT clip_id, frame_idx, win, win AS held, NULL::BIGINT AS ch, 0 AS streak FROM {el} WHERE frame_idx = 1
     UNION ALL SELECT e.clip_id, e.frame_idx, e.win,
       CASE WHEN w.held IS NULL THEN e.win WHEN e.win IS NULL OR e.win = w.held THEN w.held
            WHEN (CASE WHEN w.ch = e.win THEN w.streak + 1 ELSE 1 END) >= 3 THEN e.win ELSE w.held END,
       CASE WHEN w.held IS NULL OR e.win IS NULL OR e.win = w.held THEN NULL
            WHEN (CASE WHEN w.ch = e.win THEN w.streak + 1 ELSE 1 END) >= 3 THEN NULL ELSE e.win END,
       CASE WHEN w.held IS NULL OR e.win IS NULL OR e.win = w.held THEN 0
            WHEN (CASE WHEN w.ch = e.win THEN w.streak + 1 ELSE 1 END) >= 3 THEN 0 ELSE (CASE WHEN w.ch = e.win THEN w.streak + 1 ELSE 1 END) END
     FROM walk_hold w JOIN {el} e ON e.clip_id = w.clip_id AND e.frame_idx = w.frame_idx + 1)"""


_HOLD = """el AS (SELECT CAST(user_id AS BIGINT) AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_idx,
     CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 END::BIGINT AS win FROM events), """ + hold_sql("el")


@query("trk_07_hold_speaker", "WITH RECURSIVE " + _HOLD + " SELECT clip_id, frame_idx, CAST(held AS BIGINT) AS track_id FROM walk_hold")
def trk7(spark, sf):
    from ..operators.scaling import block_of, running
    ev = t.events(spark, sf)
    ev = running(ev, ["user_id"], ["ts", "event_id"], block_of(F.unix_seconds("ts"), 86_400), _n=("count", F.lit(1)))
    k = F.col("event_type")
    win = F.when(k.isin("view", "purchase"), 0).when(k.isin("click", "signup"), 1).cast("bigint")
    base = ev.select(F.col("user_id").alias("episode_id"), F.col("user_id").alias("clip_id"),
                     (F.coalesce("_n", F.lit(0)) + 1).alias("frame_idx"), "t_ms", win.alias("track_id"))
    base = stage(base, "frames")
    boxes = base.withColumn("track_id", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")))
    for c in K.BOX:
        boxes = boxes.withColumn(c, F.col("frame_idx").cast("double"))
    return K.hold_speaker(base, boxes, 3).select("clip_id", "frame_idx", "track_id")


def centers(spark, sf):
    """Crop centres from the events; a minute of the events counts as a millisecond, with
    quarters added so that times are not whole."""
    rows = t.events(spark, sf).filter(F.col("event_type").isin("view", "click")).groupBy(
        "episode_id", F.col("user_id").alias("clip_id"), F.floor(F.col("t_ms") / 60_000).alias("t_ms")).agg(
        F.max("value").alias("x")).withColumn("y", F.col("x") / 2)
    return rows.withColumn("t_ms", F.col("t_ms") + F.col("t_ms") % 4 * 0.25)


def euro_sql(points: str) -> str:
    """The filter as a recursive query over ``points`` (clip_id, t, x, i): position, slope and time
    of the last point."""
    return f"""walk_euro AS (SELECT clip_id, t, i, x::DOUBLE AS v, 0::DOUBLE AS s FROM {points} WHERE i = 1
     UNION ALL SELECT c.clip_id, c.t, c.i, CASE WHEN c.fresh THEN c.x ELSE c.k / (c.k + 1) * c.x + (1 - c.k / (c.k + 1)) * c.v END,
       CASE WHEN c.fresh THEN 0 ELSE c.slope END
     FROM (SELECT *, 2 * pi() * (1 + 0.007 * abs(slope)) * dt AS k FROM (SELECT *, a * ((x - v) / dt) + (1 - a) * s AS slope FROM (
       SELECT d.clip_id, d.t, d.i, d.x, w.v, w.s, (d.t - w.t) / 1000.0::DOUBLE AS dt, d.t - w.t >= 500 AS fresh,
         (2 * pi() * (d.t - w.t) / 1000.0::DOUBLE) / (2 * pi() * (d.t - w.t) / 1000.0::DOUBLE + 1) AS a
       FROM walk_euro w JOIN {points} d ON d.clip_id = w.clip_id AND d.i = w.i + 1))) c)"""


_EURO = """d AS (SELECT clip_id, t, x, row_number() OVER (PARTITION BY clip_id ORDER BY t) AS i FROM (
     SELECT clip_id, (m + m % 4 * 0.25)::DOUBLE AS t, x FROM (
       SELECT user_id AS clip_id, (epoch_us(ts) // 1000 - 1704067200000) // 60000 AS m, max(value) AS x FROM events
       WHERE event_type IN ('view', 'click') GROUP BY ALL))), """ + euro_sql("d")


@query("trk_08_one_euro", "WITH RECURSIVE " + _EURO + " SELECT clip_id, t::DOUBLE AS t_ms, round(v, 6) AS x FROM walk_euro")
def trk8(spark, sf):
    return K.one_euro(centers(spark, sf)).select("clip_id", "t_ms", F.round("x", 6).alias("x"))


# Track, score, elect, hold, smooth: the rules of the queries above, one on the other.
_PATH = TRACK_NN[:TRACK_NN.rindex("SELECT clip_id, frame_idx, det_idx, id AS track_id")] + """, tr AS (SELECT w.clip_id, w.frame_idx, w.det_idx, w.id AS track_id, d.t_ms, d.conf,
     (d.x1 + d.x2) / 2 AS cx, (d.y1 + d.y2) / 2 AS cy FROM walk w JOIN dets d ON d.clip_id = w.clip_id AND d.frame_idx = w.frame_idx AND d.det_idx = w.det_idx),
   pres AS (SELECT DISTINCT clip_id, track_id, t_ms FROM tr),
   sc AS (SELECT p.clip_id, p.track_id, count(DISTINCT t_ms) * 250.0 AS presence_ms, coalesce(sum(greatest(least(t_ms + 250, s + 400) - greatest(t_ms, s), 0)), 0)::DOUBLE AS overlap_ms
     FROM pres p LEFT JOIN sp ON sp.clip_id = p.clip_id GROUP BY ALL),
   won AS (SELECT tr.clip_id, tr.frame_idx, arg_max(tr.track_id, {'r': round(least(overlap_ms / presence_ms, 1), 9), 'c': conf, 'd': det_idx}) AS win
     FROM tr JOIN sc ON sc.clip_id = tr.clip_id AND sc.track_id = tr.track_id AND overlap_ms > 0
     WHERE EXISTS (SELECT 1 FROM sp WHERE sp.clip_id = tr.clip_id AND tr.t_ms >= s AND tr.t_ms < s + 400) GROUP BY ALL),
   el AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS frame_idx, frame_idx AS f, t_ms, win
     FROM (SELECT DISTINCT clip_id, frame_idx, t_ms FROM tr) LEFT JOIN won USING (clip_id, frame_idx)), """ + hold_sql("el") + """,
   boxes AS (SELECT h.clip_id, el.t_ms, last_value(tr.cx IGNORE NULLS) OVER o AS x, last_value(tr.cy IGNORE NULLS) OVER o AS y
     FROM walk_hold h JOIN el ON el.clip_id = h.clip_id AND el.frame_idx = h.frame_idx LEFT JOIN tr ON tr.clip_id = h.clip_id AND tr.frame_idx = el.f AND tr.track_id = h.held
     WINDOW o AS (PARTITION BY h.clip_id ORDER BY h.frame_idx)),
   dx AS (SELECT clip_id, t_ms::DOUBLE AS t, x, row_number() OVER (PARTITION BY clip_id ORDER BY t_ms) AS i FROM boxes WHERE x IS NOT NULL),
   dy AS (SELECT clip_id, t_ms::DOUBLE AS t, y AS x, row_number() OVER (PARTITION BY clip_id ORDER BY t_ms) AS i FROM boxes WHERE x IS NOT NULL), """ + euro_sql("dx") + ", " + euro_sql("dy").replace("walk_euro", "walk_y")


@query("trk_09_crop_path", "WITH RECURSIVE " + _PATH + """ SELECT clip_id, w.t AS t_ms, round(w.v, 6) AS x, round(y.v, 6) AS y
   FROM walk_euro w JOIN walk_y y USING (clip_id, i)""")
def trk9(spark, sf):
    p = K.crop_path(detections(spark, sf), order_speech(spark, sf), distance=25.0)
    return p.select("clip_id", "t_ms", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("trk_10_interp_keyframes", """WITH k AS (SELECT user_id AS clip_id, epoch_us(ts) // 1000 - 1704067200000 AS t, value AS x FROM events WHERE event_type = 'view'),
   q AS (SELECT user_id AS clip_id, epoch_us(ts) // 1000 - 1704067200000 AS t FROM events WHERE event_type = 'click'),
   s AS (SELECT *, lead(t) OVER w AS t1, lead(x) OVER w AS x1 FROM k WINDOW w AS (PARTITION BY clip_id ORDER BY t)),
   e AS (SELECT clip_id, min(t) AS f, arg_min(x, t) AS fx, arg_max(x, t) AS lx FROM k GROUP BY ALL)
   SELECT q.clip_id, q.t AS t_ms, round(coalesce(s.x + (s.x1 - s.x) * (q.t - s.t) / greatest(s.t1 - s.t, 1), CASE WHEN q.t < f THEN fx ELSE lx END), 6) AS x
   FROM q JOIN e ON e.clip_id = q.clip_id LEFT JOIN s ON s.clip_id = q.clip_id AND q.t >= s.t AND q.t < s.t1""")
def trk10(spark, sf):
    ev = t.events(spark, sf).withColumn("clip_id", F.col("user_id"))
    keys = ev.filter(F.col("event_type") == "view").select(*CLIP, "t_ms", F.col("value").alias("x"))
    times = ev.filter(F.col("event_type") == "click").select(*CLIP, "t_ms")
    # Key frames are hours apart here; clip key frames are fractions of a second apart.
    return K.interp_keyframes(times, keys, 21_600_000).select("clip_id", "t_ms", F.round("x", 6).alias("x"))


# -- CAP ----------------------------------------------------------------------------

def caption_words(spark, sf):
    return I.clip_words(clip_spans(spark, sf), t.words(spark, sf)).withColumn("clip_id", F.concat_ws("_", "episode_id", "clip_id"))


def phrases(spark, sf):
    return C.caption_phrases(caption_words(spark, sf))


_CAP = _CLIPSPAN + r""", tw AS (SELECT episode_id || '_' || clip_id AS clip_id, text, start_ms, end_ms,
      row_number() OVER (PARTITION BY episode_id, clip_id ORDER BY pos) AS i FROM cw),
   walk AS (SELECT clip_id, i, text, start_ms, end_ms, 1 AS ph, 1 AS n, length(text) AS c FROM tw WHERE i = 1
     UNION ALL SELECT t.clip_id, t.i, t.text, t.start_ms, t.end_ms, CASE WHEN nw THEN w.ph + 1 ELSE w.ph END, CASE WHEN nw THEN 1 ELSE w.n + 1 END,
       CASE WHEN nw THEN length(t.text) ELSE w.c + 1 + length(t.text) END
     FROM walk w JOIN tw t ON t.clip_id = w.clip_id AND t.i = w.i + 1,
       LATERAL (SELECT regexp_matches(w.text, '[.!?]$') OR w.n + 1 > 4 OR w.c + 1 + length(t.text) > 28 AS nw)),
   ph AS (SELECT clip_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, string_agg(text, ' ' ORDER BY i) AS text,
     string_agg('{\k' || ((end_ms - start_ms + 5) // 10) || '}' || text, ' ' ORDER BY i) AS karaoke FROM walk GROUP BY clip_id, ph)"""


@query("cap_01_phrases", sql("SELECT clip_id, start_ms, end_ms, n_words, text FROM ph", "words", "totals", recursive=True, extra=_CAP))
def cap1(spark, sf):
    return phrases(spark, sf).select("clip_id", "start_ms", "end_ms", "n_words", "text")


@query("cap_02_karaoke", sql("SELECT clip_id, start_ms, karaoke FROM ph", "words", "totals", recursive=True, extra=_CAP))
def cap2(spark, sf):
    return phrases(spark, sf).select("clip_id", "start_ms", "karaoke")


@query("cap_03_times", sql("""SELECT episode_id, pos, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS at
   FROM (SELECT episode_id, pos, (start_ms * 3 + pos % 10 + 5) // 10 AS cs FROM words)""", "words"))
def cap3(spark, sf):
    return t.words(spark, sf).select("episode_id", "pos", C.caption_time(F.col("start_ms") * 3 + F.col("pos") % 10).alias("at"))
