import math
import random

import pytest
from pyspark.sql import functions as F

from momentloom.operators import captions as C
from momentloom.operators import tracking as K

DET = "episode_id bigint, clip_id bigint, frame_idx bigint, t_ms bigint, det_idx bigint, x1 double, y1 double, x2 double, y2 double, conf double"


def box_iou(a, b):
    """Overlap share of two boxes, in plain Python."""
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def euro_axis(params):
    """One-Euro filter of one axis in plain Python: a function of (seconds, value)."""
    low, beta, d_cut = params
    state = []

    def share(dt, cutoff):
        r = 2.0 * math.pi * cutoff * dt
        return r / (r + 1.0)

    def feed(t, x):
        if not state:
            state[:] = [x, 0.0, t]
            return x
        value, slope, then = state
        dt = t - then
        if dt <= 0.0:
            return value
        a = share(dt, d_cut)
        slope = a * ((x - value) / dt) + (1.0 - a) * slope
        a = share(dt, low + beta * abs(slope))
        value = a * x + (1.0 - a) * value
        state[:] = [value, slope, t]
        return value

    return feed



def det(frame, idx, x, y, w=100, conf=.9, clip=1):
    return (1, clip, frame, frame * 250, idx, float(x), float(y), float(x + w), float(y + w), conf)


def frame_of(spark, rows):
    return spark.createDataFrame(rows, DET)


def iou(spark, a, b):
    return spark.range(1).select(K.iou([F.lit(float(v)) for v in a], [F.lit(float(v)) for v in b]).alias("v")).first().v


def test_iou(spark):
    assert iou(spark, (0, 0, 10, 10), (0, 0, 10, 10)) == 1
    assert iou(spark, (0, 0, 10, 10), (20, 20, 30, 30)) == 0
    assert iou(spark, (0, 0, 10, 10), (0, 5, 10, 15)) == pytest.approx(1 / 3)
    assert iou(spark, (0, 0, 0, 0), (0, 0, 0, 0)) == 0
    assert box_iou((0, 0, 10, 10), (0, 5, 10, 15)) == pytest.approx(1 / 3)


def test_nms(spark, rows):
    d = frame_of(spark, [det(0, 0, 0, 0, conf=.8), det(0, 1, 5, 5, conf=.9), det(0, 2, 500, 500, conf=.7)])
    assert rows(K.nms(d, .3), "conf") == [(.7,), (.9,)]


def test_nms_brute_force(spark):
    rng = random.Random(1)
    data = [det(f, i, rng.randint(0, 150), rng.randint(0, 150), conf=rng.choice([.5, .6, .9])) for f in range(30) for i in range(8)]
    want = []
    for f in range(30):
        kept = []
        for d in sorted((d for d in data if d[2] == f), key=lambda d: -d[9]):
            if all(box_iou(k[5:9], d[5:9]) <= .3 for k in kept):
                kept.append(d)
        want += [(d[2], d[4]) for d in kept]
    assert sorted((r.frame_idx, r.det_idx) for r in K.nms(frame_of(spark, data), .3).collect()) == sorted(want)


def slow_iou_tracks(data, thr):
    """All frames of a clip in order, empty ones included."""
    out, seen, fresh = {}, [], 0
    for f in range(max(d[2] for d in data) + 1):
        boxes = sorted((d for d in data if d[2] == f), key=lambda d: d[4])
        if not seen:
            seen = []
            for d in boxes:
                seen.append((fresh, d))
                fresh += 1
        else:
            pairs = sorted(((box_iou(p[1][5:9], d[5:9]), i, j) for i, p in enumerate(seen) for j, d in enumerate(boxes)), key=lambda x: -x[0])
            up, ud, now = set(), set(), []
            for v, i, j in pairs:
                if v >= thr and i not in up and j not in ud:
                    up.add(i)
                    ud.add(j)
                    now.append((seen[i][0], boxes[j]))
            for j, d in enumerate(boxes):
                if j not in ud:
                    now.append((fresh, d))
                    fresh += 1
            seen = now
        out.update({(f, d[4]): k for k, d in seen})
    return out


def slow_nn_tracks(data, reach):
    out, prev, fresh = {}, [], 0
    for f in range(max(d[2] for d in data) + 1):
        now, taken = [], set()
        for d in sorted(sorted((d for d in data if d[2] == f), key=lambda d: d[4]), key=lambda d: -d[9]):
            c = ((d[5] + d[7]) / 2, (d[6] + d[8]) / 2)
            best = None
            for i, (_, p) in enumerate(prev):
                r = math.dist(c, p)
                if i not in taken and r <= reach and (best is None or r < best[1]):
                    best = (i, r)
            if best:
                taken.add(best[0])
                k = prev[best[0]][0]
            else:
                k, fresh = fresh, fresh + 1
            now.append((k, c))
            out[(f, d[4])] = k
        prev = now
    return out


def clip_rows(seed, clip, frames=60):
    rng = random.Random(seed)
    return [det(f, i, 40 * i + rng.randint(-25, 25), rng.randint(0, 60), w=rng.randint(60, 110), conf=round(rng.random(), 1), clip=clip)
            for f in range(frames) if rng.random() > .15 for i in range(rng.randint(1, 4))]


def test_trackers_match_a_slow_walk(spark):
    clips = {c: clip_rows(c, c) for c in (1, 2, 3)}
    df = frame_of(spark, sum(clips.values(), []))
    got = {(r.clip_id, r.frame_idx, r.det_idx): r.track_id for r in K.track_iou(df, .3).collect()}
    near = {(r.clip_id, r.frame_idx, r.det_idx): r.track_id for r in K.track_nn(df, 60.0).collect()}
    for c, data in clips.items():
        assert {k[1:]: v for k, v in got.items() if k[0] == c} == slow_iou_tracks(data, .3)
        assert {k[1:]: v for k, v in near.items() if k[0] == c} == slow_nn_tracks(data, 60.0)


def test_tracker_keeps_and_creates_ids(spark):
    d = frame_of(spark, [det(0, 0, 0, 0), det(1, 0, 5, 5), det(1, 1, 600, 0), det(3, 0, 5, 5)])
    got = {(r.frame_idx, r.det_idx): r.track_id for r in K.track_iou(d).collect()}
    assert got == {(0, 0): 0, (1, 0): 0, (1, 1): 1, (3, 0): 2}


def test_trackers_match_a_slow_walk_in_long_clips(spark, monkeypatch):
    monkeypatch.setattr(K, "FRAME_BLOCK", 8)
    clips = {1: clip_rows(5, 1), 2: clip_rows(6, 2, frames=7)}
    df = frame_of(spark, sum(clips.values(), []))
    for got, slow in ((K.track_iou(df, .3), lambda d: slow_iou_tracks(d, .3)), (K.track_nn(df, 60.0), lambda d: slow_nn_tracks(d, 60.0))):
        rows = got.collect()
        for c, data in clips.items():
            assert {(r.frame_idx, r.det_idx): r.track_id for r in rows if r.clip_id == c} == slow(data)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ")


def test_boxes_move_once(spark):
    """tracking shuffled its boxes five times."""
    df = frame_of(spark, clip_rows(1, 1))
    assert shuffles(K.track_nn(df)) == shuffles(K.track_iou(df)) == 1


SPEECH = "episode_id bigint, start_ms bigint, end_ms bigint"


def test_election(spark):
    two = frame_of(spark, [det(f, i, 300 * i, 0, conf=.9 if i else .8) for f in range(4) for i in (0, 1)] + [det(f, 1, 300, 0) for f in range(4, 8)])
    tracks = two.withColumn("track_id", F.col("det_idx"))
    sp = spark.createDataFrame([(1, 250, 1000)], SPEECH)
    s = {r.track_id: r.ratio for r in K.speech_scores(tracks, sp).collect()}
    assert s == {0: .75, 1: .375}
    e = {r.frame_idx: r.track_id for r in K.elect_speaker(tracks, K.speech_scores(tracks, sp), sp).collect()}
    assert e == {0: None, 1: 0, 2: 0, 3: 0, 4: None, 5: None, 6: None, 7: None}
    equal = K.speech_scores(tracks.filter("frame_idx < 4"), sp)
    e = {r.frame_idx: r.track_id for r in K.elect_speaker(tracks.filter("frame_idx < 4"), equal, sp).collect()}
    assert e == {0: None, 1: 1, 2: 1, 3: 1}


def slow_hold(wins, boxes, hold):
    held, box, rival, streak, out = None, None, None, 0, []
    for f, w in enumerate(wins):
        if held is None and w is not None:
            held, box, rival, streak = w, boxes.get((f, w)), None, 0
        elif held is not None and (w is None or w == held):
            box, rival, streak = boxes.get((f, held), box), None, 0
        elif held is not None:
            streak = streak + 1 if rival == w else 1
            rival = w
            if streak >= hold:
                held, box, rival, streak = w, boxes.get((f, w)), None, 0
            else:
                box = boxes.get((f, held), box)
        out.append((held, box))
    return out


@pytest.mark.parametrize("hold,n", [(3, 300), (2, 9000), (1, 40)])
def test_hold_matches_a_slow_walk(spark, hold, n):
    rng = random.Random(hold)
    wins = [None] * 5 + [rng.choice([0, 0, 0, 1, 1, 2, None]) for _ in range(n)]
    boxes = {(f, k): float(f * 10 + k) for f in range(len(wins)) for k in range(3) if wins[f] == k or rng.random() > .5}
    el = spark.createDataFrame([(1, 1, f, f * 250, w, *([boxes[(f, w)]] * 4 if w is not None else [None] * 4)) for f, w in enumerate(wins)],
                               "episode_id bigint, clip_id bigint, frame_idx bigint, t_ms bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double")
    tr = spark.createDataFrame([(1, 1, f, k, *([x] * 4)) for (f, k), x in boxes.items()],
                               "episode_id bigint, clip_id bigint, frame_idx bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double")
    got = [(r.track_id, r.x1) for r in K.hold_speaker(el, tr, hold).orderBy("frame_idx").collect()]
    want = slow_hold(wins, boxes, hold) if hold > 1 else [(w, boxes.get((f, w))) for f, w in enumerate(wins)]
    assert got == want


def test_hold_ignores_a_flicker(spark):
    wins = [0, 0, 1, 0, 1, 1, 1]
    tr = {(f, k): float(k) for f in range(7) for k in (0, 1)}
    assert [h for h, _ in slow_hold(wins, tr, 3)] == [0, 0, 0, 0, 0, 0, 1]


def test_one_euro(spark):
    pts = [(1, 1, i * 50, 100.0 + i, 5.0) for i in range(20)] + [(1, 1, 950 + 500, 800.0, 5.0), (1, 1, 1450 + 300, 900.0, 5.0), (1, 1, 1750, None, None)]
    df = spark.createDataFrame(pts, "episode_id bigint, clip_id bigint, t_ms bigint, x double, y double")
    out = [r.x for r in K.one_euro(df).orderBy("t_ms").collect()]
    assert len(out) == 22 and out[0] == 100 and out[20] == 800 and 800 < out[21] < 900
    fx = euro_axis(K.ONE_EURO)
    assert out[:20] == pytest.approx([fx(i * .05, 100.0 + i) for i in range(20)])
    assert all(99 <= x <= 119 for x in out[:20])


def test_one_euro_measures_gaps_on_exact_times(spark):
    pts = [(1, 1, 124.9, 100.0, 5.0), (1, 1, 624.5, 200.0, 5.0), (1, 1, 1124.5, 300.0, 5.0)]
    df = spark.createDataFrame(pts, "episode_id bigint, clip_id bigint, t_ms double, x double, y double")
    out = [r.x for r in K.one_euro(df).orderBy("t_ms").collect()]
    assert out[0] == 100 and 100 < out[1] < 200 and out[2] == 300   # gaps of 499.6 and 500 ms


def test_interpolation(spark):
    keys = spark.createDataFrame([(1, 1, 1000, 10.0), (1, 1, 2000, 20.0), (1, 1, 4000, 0.0)], "episode_id bigint, clip_id bigint, t_ms bigint, x double")
    times = spark.createDataFrame([(1, 1, t) for t in (0, 1000, 1500, 2000, 3000, 4000, 9000)], "episode_id bigint, clip_id bigint, t_ms bigint")
    assert [r.x for r in K.interp_keyframes(times, keys).orderBy("t_ms").collect()] == [10, 10, 15, 20, 10, 0, 0]


def test_crop_path_runs_end_to_end(spark):
    d = frame_of(spark, [det(f, 0, 10 * f, 0) for f in range(8)] + [det(f, 1, 600, 0, conf=.5) for f in range(8)])
    sp = spark.createDataFrame([(1, 0, 2000)], SPEECH)
    got = K.crop_path(d, sp).orderBy("t_ms").collect()
    assert len(got) == 8 and got[0].x == 50 and all(50 <= r.x <= 120 for r in got)


def test_crop_path_in_a_clip_is_that_of_the_operators(spark, monkeypatch):
    """boxes move three times and speech once; the rows are those of the steps one by one."""
    d = frame_of(spark, sum([clip_rows(c, c) for c in (1, 2, 3)], [])).withColumn("episode_id", F.col("clip_id") % 2)
    sp = spark.createDataFrame([(e, s, s + n) for e in (0, 1) for s, n in ((-100, 400), (900, 1300), (1500, 400), (6000, 3000), (29_900, 200))], SPEECH)
    for hold in (1, 3):
        got = K.crop_path(d, sp, distance=60.0, hold=hold)
        assert shuffles(got) <= 4
        tracks = K.track_nn(d, 60.0)
        want = K.one_euro(K._centers(K.hold_speaker(K.elect_speaker(tracks, K.speech_scores(tracks, sp), sp), tracks, hold)))
        want = sorted(map(tuple, want.collect()))
        assert want and sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(K, "FRAME_BLOCK", 8)
    assert sorted(map(tuple, K.crop_path(d, sp, distance=60.0).collect())) == want


# -- captions --

def words(spark, texts, step=300, clip="c"):
    return spark.createDataFrame([(clip, i, t, i * step, i * step + step) for i, t in enumerate(texts)],
                                 "clip_id string, pos bigint, text string, start_ms bigint, end_ms bigint")


def said(df):
    return [r.text for r in df.orderBy("start_ms").collect()]


def test_phrases(spark):
    w = "one two three four five six seven".split()
    assert said(C.caption_phrases(words(spark, w), 3, 100)) == ["one two three", "four five six", "seven"]
    assert said(C.caption_phrases(words(spark, "Hello world. How are you? Fine.".split()), 10, 100)) == ["Hello world.", "How are you?", "Fine."]
    assert said(C.caption_phrases(words(spark, [" ", "\t", ""]), 4, 28)) == []
    assert said(C.caption_phrases(words(spark, ["abcdefgh", "i", "jk"]), 0, 1)) == ["abcdefgh", "i", "jk"]


def slow_phrases(texts, max_words, max_chars):
    out, buf = [], []
    for t in texts:
        if buf and (len(buf) + 1 > max_words or len(" ".join([*buf, t])) > max_chars):
            out.append(" ".join(buf))
            buf = []
        buf.append(t)
        if t[-1] in ".!?":
            out.append(" ".join(buf))
            buf = []
    return out + ([" ".join(buf)] if buf else [])


def test_phrases_match_a_slow_walk(spark):
    rng = random.Random(9)
    t = ["x" * rng.randint(1, 12) + rng.choice(["", "", "", ".", "!"]) for _ in range(6000)]
    assert said(C.caption_phrases(words(spark, t), 5, 36)) == slow_phrases(t, 5, 36)


def test_phrases_are_not_folded_by_lambdas(spark):
    """F15, F16: a lambda for each word took most of the time."""
    plan = C.caption_phrases(words(spark, ["a", "b."]))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_karaoke(spark):
    df = spark.createDataFrame([("c", 0, "Hello", 0, 300), ("c", 1, "world", 300, 700), ("c", 2, "today", 700, 1000)],
                               "clip_id string, pos bigint, text string, start_ms bigint, end_ms bigint")
    assert C.caption_phrases(df).first().karaoke == "{\\k30}Hello {\\k40}world {\\k30}today"
    flat = spark.createDataFrame([("c", 0, "a", 0, 300), ("c", 1, "b", 0, 300)], df.schema)
    assert C.caption_phrases(flat).first().karaoke == "a b"


@pytest.mark.parametrize("ms,want", [(0, "0:00:00.00"), (61_250, "0:01:01.25"), (3_661_990, "1:01:01.99"), (-5, "0:00:00.00"), (999_995, "0:16:40.00")])
def test_caption_time(spark, ms, want):
    assert spark.range(1).select(C.caption_time(F.lit(ms)).alias("v")).first().v == want
