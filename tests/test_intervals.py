import random

import pytest
from pyspark.sql import functions as F

from momentloom.operators import intervals as I
from momentloom.operators.scaling import runs, running, block_of, interval_overlap


def ivs(spark, rows, cols="episode_id bigint, start_ms bigint, end_ms bigint"):
    return spark.createDataFrame(rows, cols)


def dense_words(spark, seconds):
    n = seconds * 3
    return spark.range(n).select(F.lit(1).cast("bigint").alias("episode_id"), F.col("id").alias("pos"), F.lit("w").alias("text"),
                                 F.floor(F.col("id") * 1000 / 3).alias("start_ms"), F.floor(F.col("id") * 1000 / 3 + 200).alias("end_ms"))


# -- INT-1, INT-2 --

def test_islands_literal(spark, rows):
    probs = [.1] * 3 + [.9] * 4 + [.05] * 3
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(probs)], "episode_id bigint, frame_idx bigint, prob double")
    assert rows(I.islands(df, .5, 50, 32)) == [(1, 0, 96), (1, 224, 320)]
    one = spark.createDataFrame([(1, i, p) for i, p in enumerate([.9, .1, .9, .9])], df.schema)
    assert rows(I.islands(one, .5, 100, 32)) == []


def test_islands_across_blocks_and_hot_episode(spark, rows):
    rng = random.Random(1)
    data, want = [], []
    for ep, n in ((1, 20_000), (2, 300), (3, 10)):
        probs, i = [], 0
        while i < n:
            k = rng.choice([1, 2, 5, 40, 6000 if ep == 1 else 7])
            probs += [rng.choice([.1, .9])] * k
            i += k
        start = None
        for j, p in enumerate(probs + [1.0]):
            if p < .5 and start is None:
                start = j
            if p >= .5 and start is not None:
                if (j - start) * 10 >= 30:
                    want.append((ep, start * 10, j * 10))
                start = None
        data += [(ep, j, p) for j, p in enumerate(probs)]
    df = spark.createDataFrame(data, "episode_id bigint, frame_idx bigint, prob double")
    assert rows(I.islands(df, .5, 30, 10)) == sorted(want, key=repr)


@pytest.mark.parametrize("sil,total,least,want", [
    ([(0, 1500), (2500, 4000)], 6000, 100, [(1500, 2500), (4000, 6000)]),
    ([], 10_000, 100, [(0, 10_000)]),
    ([(0, 1000), (1050, 2000)], 3000, 500, [(2000, 3000)]),
    ([(0, 5000), (1000, 2000), (4000, 9000)], 10_000, 0, [(9000, 10_000)]),
    ([(0, 10)], 0, 0, []),
])
def test_invert(spark, rows, sil, total, least, want):
    df = ivs(spark, [(1, *s) for s in sil])
    t = spark.createDataFrame([(1, total)], "episode_id bigint, total_ms bigint")
    assert rows(I.invert_intervals(df, t, least)) == [(1, *w) for w in want]


def test_speech_and_silence_cover_everything(spark):
    rng = random.Random(2)
    sil = [(1, a, a + rng.randint(1, 5_000_000)) for a in (rng.randint(0, 30_000_000) for _ in range(60))]
    t = spark.createDataFrame([(1, 36_000_000)], "episode_id bigint, total_ms bigint")
    gaps = [(r.start_ms, r.end_ms) for r in I.invert_intervals(ivs(spark, sil), t, 0).collect()]
    marks = sorted([(s, min(e, 36_000_000)) for _, s, e in sil if s < 36_000_000] + gaps)
    at = 0
    for s, e in marks:
        assert s <= at
        at = max(at, e)
    assert at == 36_000_000
    assert all(not (s < b and e > a) for s, e in gaps for _, a, b in sil)


# -- INT-3 --

def snapped(spark, points, bounds, drift):
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(points)], "episode_id bigint, pid bigint, t_ms bigint")
    b = spark.createDataFrame([(1, *x) for x in bounds], "episode_id bigint, start_ms bigint, end_ms bigint")
    out = I.snap(p, I.silence_boundaries(b), drift, ["pid"]).orderBy("pid").collect()
    return [r.snapped_ms for r in out]


def test_snap(spark):
    assert snapped(spark, [1400, 2600, 0], [(1500, 2500)], 500) == [1500, 2500, 0]
    assert snapped(spark, [5000], [], 500) == [5000]
    # Equally near: the later boundary wins; the drift itself still counts.
    assert snapped(spark, [2000], [(1500, 2500)], 500) == [2500]
    assert snapped(spark, [950, 2050, 3000], [(1000, 1500), (1600, 2000)], 100) == [1000, 2000, 3000]


# -- INT-4..7 --

def test_dense_windows(spark):
    p = I.WindowParams(target_ms=60_000, min_ms=25_000, max_ms=90_000, stride_ms=30_000, min_words=30)
    t = spark.createDataFrame([(1, 300_000)], "episode_id bigint, total_ms bigint")
    none = ivs(spark, [])
    shots = spark.createDataFrame([], "episode_id bigint, t_ms bigint")
    w = I.dedupe_windows(I.window_words(I.snap_windows(I.grid(t, p), none, shots, p), dense_words(spark, 300)), p)
    got = w.orderBy("start_ms").collect()
    assert got and all(25_000 <= r.end_ms - r.start_ms <= 90_000 and r.word_count >= 30 for r in got)
    steps = [b.start_ms - a.start_ms for a, b in zip(got, got[1:])]
    assert all(0 < s <= 60_000 for s in steps)


def test_short_and_sparse_recordings_have_no_windows(spark):
    p = I.WindowParams(target_ms=60_000, min_ms=25_000, max_ms=90_000, stride_ms=30_000, min_words=30)
    t = spark.createDataFrame([(1, 0), (2, 10_000), (3, 120_000)], "episode_id bigint, total_ms bigint")
    shots = spark.createDataFrame([], "episode_id bigint, t_ms bigint")
    words = spark.createDataFrame([(3, i, "x", i * 1000, i * 1000 + 100) for i in range(3)],
                                  "episode_id bigint, pos bigint, text string, start_ms bigint, end_ms bigint")
    w = I.dedupe_windows(I.window_words(I.snap_windows(I.grid(t, p), ivs(spark, []), shots, p), words), p)
    assert w.count() == 0


def test_start_on_boundary_still_asks_the_shots(spark):
    p = I.WindowParams()
    t = spark.createDataFrame([(1, 60_000)], "episode_id bigint, total_ms bigint")
    sil = ivs(spark, [(1, 15_000, 15_100)])
    shots = spark.createDataFrame([(1, 15_600)], "episode_id bigint, t_ms bigint")
    w = {r.window_id: r for r in I.snap_windows(I.grid(t, p), sil, shots, p).collect()}
    assert w[1].start_ms == 15_600      # on the silence edge counts as not snapped
    assert w[0].start_ms == 0


def test_dedupe_windows_is_sequential(spark):
    p = I.WindowParams(stride_ms=200, min_ms=0, min_words=0)
    rng = random.Random(3)
    data, want = [], []
    for ep in (1, 2):
        last = None
        for i in range(9000 if ep == 1 else 50):
            s = i * 200 + rng.randint(-300, 300)
            e = s + 20_000 + rng.choice([0, 0, 600])
            data.append((ep, i, s, e, 5))
            if last is None or abs(last[0] - s) >= 500 or abs(last[1] - e) >= 500:
                last = (s, e)
                want.append((ep, i))
    df = spark.createDataFrame(data, "episode_id bigint, window_id bigint, start_ms bigint, end_ms bigint, word_count bigint")
    got = [(r.episode_id, r.window_id) for r in I.dedupe_windows(df, p).select("episode_id", "window_id").collect()]
    assert sorted(got) == sorted(want)


def test_near_windows_are_one_whatever_the_stride(spark):
    rows = [(1, 0, 0, 20_000, 40), (1, 1, 100, 20_100, 40), (1, 2, 30_000, 50_000, 40)]
    df = spark.createDataFrame(rows, "episode_id bigint, window_id bigint, start_ms bigint, end_ms bigint, word_count bigint")
    assert sorted(r.window_id for r in I.dedupe_windows(df, I.WindowParams()).collect()) == [0, 2]


def test_rate(spark):
    words = spark.createDataFrame([(1, i, "a", t, t + 50) for i, t in enumerate([100, 400, 700, 1500])],
                                  "episode_id bigint, pos bigint, text string, start_ms bigint, end_ms bigint")
    w = spark.createDataFrame([(1, 0, 0, 1000), (1, 1, 0, 0)], "episode_id bigint, window_id bigint, start_ms bigint, end_ms bigint")
    got = {r.window_id: r.speaking_rate for r in I.window_words(w, words).collect()}
    assert got == {0: 3.0, 1: None}


# -- INT-8..11 --

def test_drop_contained(spark, rows):
    words = spark.createDataFrame([(1, 0, 100, 200), (1, 1, 150, 900), (1, 2, 950, 1000)],
                                  "episode_id bigint, pos bigint, start_ms bigint, end_ms bigint")
    assert rows(I.drop_contained(words, ivs(spark, [(1, 100, 300), (1, 900, 1000)])), "pos") == [(1,)]


def brute_gap(ts, eps):
    kept = []
    for t in sorted(set(ts)):
        if not kept or t - kept[-1] >= eps:
            kept.append(t)
    return kept


def test_gap_dedupe_compares_with_last_kept(spark, rows):
    df = spark.createDataFrame([(1, t) for t in (0, 3, 6, 12, 13)], "episode_id bigint, t bigint")
    assert sorted(r[1] for r in rows(I.dedupe_by_gap(df, ["episode_id"], "t", 5))) == [0, 6, 12]


def test_gap_dedupe_on_a_dense_run_across_blocks(spark):
    rng = random.Random(4)
    ts = [rng.randint(3_500_000, 3_700_000) for _ in range(30_000)] + [9_000_000, 9_000_004]
    df = spark.createDataFrame([(1, t) for t in ts], "episode_id bigint, t bigint")
    got = sorted(r.t for r in I.dedupe_by_gap(df, ["episode_id"], "t", 10).collect())
    assert got == brute_gap(ts, 10)


def test_overlap_and_in_any(spark, rows):
    sp = ivs(spark, [(1, 2000, 5000)])
    w = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate([(2500, 4000), (1000, 3000), (4000, 6000), (0, 1000), (0, 10_000)])],
                              "episode_id bigint, window_id bigint, start_ms bigint, end_ms bigint")
    got = {r.window_id: r.overlap_ms for r in I.overlap_ms(w, sp, ["window_id"]).collect()}
    assert got == {0: 1500, 1: 1000, 2: 1000, 3: 0, 4: 3000}
    pts = spark.createDataFrame([(1, t) for t in (500, 1000, 2000, 3000, 4000, 6000)], "episode_id bigint, t_ms bigint")
    assert sorted(r[1] for r in rows(I.in_any(pts, ivs(spark, [(1, 1000, 3000), (1, 5000, 7000)])))) == [1000, 2000, 6000]


def test_interval_overlap_pairs_once(spark):
    rng = random.Random(5)
    a = [(1, i, s, s + rng.randint(1, 90_000)) for i, s in enumerate(rng.randint(0, 400_000) for _ in range(80))]
    b = [(1, i, s, s + rng.randint(1, 90_000)) for i, s in enumerate(rng.randint(0, 400_000) for _ in range(80))]
    da = spark.createDataFrame(a, "episode_id bigint, i bigint, s bigint, e bigint")
    db = spark.createDataFrame(b, "episode_id bigint, j bigint, u bigint, v bigint")
    got = [(r.i, r.j) for r in interval_overlap(da, db, ["episode_id"], "s", "e", "u", "v", 30_000).collect()]
    want = [(x[1], y[1]) for x in a for y in b if x[2] < y[3] and x[3] > y[2]]
    assert sorted(got) == sorted(want)


# -- INT-12..19 --

def test_stitch_shifts_and_clamps(spark, rows):
    c = spark.createDataFrame([(1, 0, 10_000, [("hello", 0.0, .5), ("world", .6, 1.0)], [(0.0, 1.0, "hello world"), (1.0, 2.0, " ")]),
                               (1, 1, 0, [("oops", -.1, .2)], [])],
                              "episode_id bigint, chunk_idx bigint, offset_ms bigint, words array<struct<word:string,start:double,end:double>>, "
                              "segments array<struct<start:double,end:double,text:string>>")
    w, s = I.stitch_chunks(c)
    assert rows(w, "text", "start_ms", "end_ms") == [("hello", 10_000, 10_500), ("oops", 0, 200), ("world", 10_600, 11_000)]
    assert rows(s, "text", "start_ms") == [("hello world", 10_000)]


def test_recut_bounds(spark, rows):
    clips = spark.createDataFrame([(1, c, 10_000, 40_000) for c in "abcd"], "episode_id bigint, clip_id string, start_ms bigint, end_ms bigint")
    edits = spark.createDataFrame([("a", 12.0, 20.0), ("b", 12.0, 14.0), ("c", 0.0, 400.0), ("d", float("nan"), 3.0)],
                                  "clip_id string, new_start_s double, new_end_s double")
    words = spark.createDataFrame([("a", 0, "x", 1999, 2100), ("a", 1, "y", 5000, 10_500), ("a", 2, "z", 5000, 10_501)],
                                  "clip_id string, pos bigint, text string, start_ms bigint, end_ms bigint")
    bounds, kept, bad = I.recut(clips, edits, words)
    assert rows(bounds, "clip_id", "start_ms", "end_ms") == [("a", 12_000, 20_000)]
    assert rows(kept, "text", "start_ms", "end_ms") == [("x", 0, 100), ("y", 3000, 8500)]
    assert rows(bad) == [("b", "duration 2.0s below 3s minimum"), ("c", "duration 400.0s above 300s maximum"),
                         ("d", "start/end must be finite")]


def test_repair_moments(spark):
    m = spark.createDataFrame([(1, 0, 5.0, "a"), (1, 1, float("nan"), ""), (1, 2, 5.1, "b"), (2, 0, 1.0, "z")],
                              "episode_id bigint, pos bigint, center_s double, reason string")
    s = spark.createDataFrame([(1, 0, 20_250), (2, 0, 0), (3, 0, 10_250)], "episode_id bigint, start_ms bigint, end_ms bigint")
    got = [(r.episode_id, r.t_ms, r.reason) for r in I.repair_moments(m, s, 5).orderBy("episode_id", "slot").collect()]
    # Episode 1: three given, two padded at positions 3 and 5 of step 5 s (the second held at the end).
    assert [g for g in got if g[0] == 1] == [(1, 0, I.UNNAMED), (1, 5000, "a"), (1, 15_000, I.FILLER), (1, 20_000, I.FILLER)]
    assert [g[1] for g in got if g[0] == 3] == [0, 5000, 10_000]


# -- blocks --

def test_running_matches_a_plain_scan(spark):
    rng = random.Random(6)
    data = [(k, i, rng.randint(0, 9)) for k in (1, 2) for i in range(5000 if k == 1 else 40)]
    df = spark.createDataFrame(data, "k bigint, i bigint, v bigint")
    got = {(r.k, r.i): (r.s or 0, r.c or 0, r.m) for r in running(
        df, ["k"], ["i"], block_of("i", 64), s=("sum", F.col("v")), c=("count", F.lit(1)), m=("max", F.col("v"))).collect()}
    for k in (1, 2):
        seen = []
        for _, i, v in [d for d in data if d[0] == k]:
            assert got[(k, i)] == (sum(seen[-10**6:]), len(seen), max(seen) if seen else None)
            seen.append(v)
            if i > 300:
                break


def test_runs_match_a_plain_scan(spark):
    rng = random.Random(7)
    data, want = [], {}
    for k in (1, 2, 3):
        t, far, run = 0, None, None
        for _ in range(3000):
            t += rng.choice([1, 1, 2, 3, 80])
            if far is None or t - far >= 3:
                run = t
            far = t if far is None else max(far, t)
            data.append((k, t))
            want[(k, t)] = run
    got = {(r.k, r.t): r.run_id for r in runs(spark.createDataFrame(data, "k bigint, t bigint"), ["k"], "t", "t", 3, 50).collect()}
    assert got == want


def test_words_and_marks_move_slim(spark):
    """A window's words come as one row per block, with the texts in order over blocks, ties and missing
    texts; marks aren't copied for each kind before they move."""
    said = [("e", i, None if i % 7 == 3 else f"w{i}", (i // 2) * 900) for i in range(200)]
    words = spark.createDataFrame(said, "episode_id string, pos bigint, text string, start_ms bigint")
    spans = [("e", 0, 0, 20_000), ("e", 1, 25_000, 65_000), ("e", 2, 500_000, 510_000), ("f", 3, 0, 9_000), ("e", 4, 5_000, 5_000)]
    windows = spark.createDataFrame(spans, "episode_id string, window_id bigint, start_ms bigint, end_ms bigint")
    inside = {w: [r for r in said if e == r[0] and a <= r[3] < z] for e, w, a, z in spans}
    got = {r.window_id: r for r in I.window_words(windows, words).collect()}
    assert {w: r.word_count for w, r in got.items()} == {w: len(v) for w, v in inside.items()}
    assert {w: r.transcript for w, r in got.items()} == {w: " ".join(r[2] for r in v if r[2]) for w, v in inside.items()}
    assert {r.window_id: r.word_count for r in I.count_words(windows, words).collect()} == {w: len(v) for w, v in inside.items()}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(I.window_words(windows, words))
    assert "collect_list" in text[text.index("Join"):]       # below the join
    marks = I.silence_boundaries(windows.select("episode_id", "start_ms", "end_ms"))
    snapped = plan(I.snap(words.select("episode_id", "pos", F.col("start_ms").alias("t_ms")), marks, 800, ["pos"]))
    assert "_mark" not in snapped[snapped.index("Exchange hashpartitioning"):]


def test_minute_index_moves_texts_once(spark):
    """texts moved to their segment, to their minute and to their episode."""
    rows = [(e, m * 60_000 + k, k, f"t{e} {m} {k}") for e in (1, 2) for m in (0, 3, 4, 9)[:4 - e] for k in range(3)]
    segs = spark.createDataFrame(rows, "episode_id bigint, start_ms bigint, ord bigint, text string")
    index = I.minute_index(segs, max_minutes=2)
    want = [(e, m, "".join(f"t{e} {m} {k} " for k in range(3))) for e in (1, 2) for m in (0, 3)]
    assert sorted((r.episode_id, r.minute, r.text) for r in index.collect()) == want
    plan = index._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert sum("Exchange " in x and "minute" not in x for x in plan.splitlines()) <= 1   # numbers of minutes by episode


def test_segments_are_cut_where_the_words_are(spark, tmp_path):
    """words were exploded and gathered again."""
    from momentloom.plans.timeline_queries import six_word_segments
    texts = {1: " ".join(f"w{i}" for i in range(13)), 2: "", 3: None, 4: " a\tb ", 5: "a b c d e f"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = six_word_segments(spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(d, k, 4_800 * k, " ".join(w[6 * k:6 * k + 6])) for d, x in texts.items() if (w := (x or "").split()) for k in range((len(w) + 5) // 6)]
    assert sorted((r.episode_id, r.ord, r.start_ms, r.text) for r in got.collect()) == want


def test_islands_across_blocks(spark, monkeypatch):
    """frames move as one array a block, not as rows that are sorted twice and joined."""
    monkeypatch.setattr(I, "FRAME_BLOCK", 8)
    rng = random.Random(3)
    quiet = {1: set(range(5, 27)) | {40, 41}, 2: {i for i in range(300) if rng.random() < .8}, 3: {7, 8, 15, 24}, 4: set()}
    rows = [(e, i, 0.1 if i in q else 0.9) for e, q in quiet.items() for i in range(300)] + [(1, 6, 0.1)]
    rng.shuffle(rows)
    frames = spark.createDataFrame(rows, "episode_id bigint, frame_idx bigint, prob double").repartition(3)
    got = I.islands(frames, 0.5, 20, 10)
    want = []
    for e, q in quiet.items():
        for i in sorted(q):
            if i - 1 not in q:
                end = i
                while end in q:
                    end += 1
                if end - i >= 2:
                    want.append((e, 10 * i, 10 * end))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_recut_reads_its_clips_once(spark):
    """each of the three results worked out the clips and edits anew."""
    clips = spark.createDataFrame([(1, "a", 1000, 60_000)], "episode_id bigint, clip_id string, start_ms bigint, end_ms bigint")
    edits = spark.createDataFrame([("a", 2.0, 8.0)], "clip_id string, new_start_s double, new_end_s double")
    said = spark.createDataFrame([(1, "a", 0, "x", 1000, 1300), (1, "a", 1, "y", 0, 300)], "episode_id bigint, clip_id string, pos bigint, text string, start_ms bigint, end_ms bigint")
    bounds, kept, bad = I.recut(clips, edits, said)
    assert [tuple(r) for r in bounds.collect()] == [(1, "a", 2000, 8000)] and [r.text for r in kept.collect()] == ["x"] and bad.count() == 0
    assert "Join" not in bounds._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("pack_bytes", [1, 1 << 20])
def test_words_of_windows_move_packed(spark, monkeypatch, pack_bytes):
    """Ties of time, missing texts and positions, negative times, a window of many blocks and one without words."""
    from momentloom.operators import packed

    monkeypatch.setattr(packed, "PACK_BYTES", pack_bytes)
    words = [("a", i % 7 if i % 5 else None, None if i % 6 == 0 else f"w{i}", (i * 37) % 900 - 200) for i in range(150)] + [("b", 1, "", 5), (None, 1, "lost", 5), ("a", 1, "no time", None)]
    windows = [("a", 1, -200, 700), ("a", 2, 0, 50), ("a", 3, 100, 100), ("a", 4, 5_000, 9_000), ("b", 1, 0, 10), ("c", 1, 0, 10), (None, 1, 0, 10)]
    given = spark.createDataFrame(words, "episode_id string, pos int, text string, start_ms bigint")
    asked = spark.createDataFrame(windows, "episode_id string, window_id bigint, start_ms bigint, end_ms bigint")
    out = I.packed_window_words(asked, given, width=100, joiner="|")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, I.window_words(asked, given, width=100, joiner="|").collect()), key=repr)
    got = {(r.episode_id, r.window_id): (r.word_count, r.transcript) for r in out.collect()}
    want = {}
    for e, k, a, z in windows:
        inside = sorted((w for w in words if e is not None and w[0] == e and w[3] is not None and a <= w[3] < z),
                        key=lambda w: (w[3], w[1] is not None, w[1] or 0, w[2] is not None, w[2] or ""))
        want[e, k] = (len(inside), "|".join(w[2] for w in inside if w[2] is not None))
    assert got == want and len(got) == out.count()
    counted = {(r.episode_id, r.window_id): r.word_count for r in I.count_words(asked, given, width=100).collect()}
    assert counted == {k: n for k, (n, _) in want.items()}
    # Only the texts of windows are collected; words are not gathered into arrays of structs before they move.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1


def test_neighbours_are_sorted_in_small_parts(spark):
    """a task of the session's partitions spilled what it sorted."""
    points = spark.createDataFrame([("e", i, i * 7) for i in range(100)], "episode_id string, pos bigint, t_ms bigint")
    marks = spark.createDataFrame([("e", i * 50, i) for i in range(20)], "episode_id string, b_ms bigint, ord bigint")
    out = I.snap(points, marks, 30, ["pos"])
    assert {r.pos: r.snapped_ms for r in out.collect()} == {i: min((b * 50 for b in range(20)), key=lambda m: (abs(m - i * 7), -m)) for i in range(100)} | {
        i: i * 7 for i in range(100) if abs(950 - i * 7) > 30 and i * 7 > 950}
    assert ", 16), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
