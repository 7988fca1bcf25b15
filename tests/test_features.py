import math

import pytest
from pyspark.sql import functions as F

from momentloom.operators import features as FT


def windows(spark, *spans):
    return spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(spans)],
                                 "episode_id bigint, window_id bigint, start_ms bigint, end_ms bigint")


def test_rms(spark):
    rms = spark.createDataFrame([(1, i * 1000, v) for i, v in enumerate([-30., -10., -20., -40.])] + [(1, 500, float("-inf"))],
                                "episode_id bigint, t_ms bigint, rms_db double")
    got = {r.window_id: r for r in FT.rms_features(windows(spark, (500, 2500), (0, 3000), (9000, 9500)), rms).collect()}
    assert got[0].rms_peak_db == -10 and got[1].rms_mean_db == -20 and 2 not in got


def test_f0(spark):
    f0 = spark.createDataFrame([(1, 0, 100.), (1, 500, 200.), (1, 1000, 0.), (1, 1500, 300.), (1, 5000, 999.), (1, 8000, 0.)],
                               "episode_id bigint, t_ms bigint, pitch_hz double")
    got = {r.window_id: r for r in FT.f0_features(windows(spark, (0, 2000), (7000, 9000)), f0).collect()}
    assert got[0].f0_mean_hz == 200 and got[0].f0_peak_hz == 300 and abs(got[0].f0_variance_hz2 - 6666.6667) < 1e-3
    assert 1 not in got


def test_class_groups(spark):
    logits = [0.0] * 20
    logits[13], logits[3] = 5.0, 4.0
    r = spark.createDataFrame([(logits,)], "v array<float>").select(FT.class_groups("v").alias("g")).first().g
    total = sum(math.exp(x) for x in logits)
    assert r.laughter == pytest.approx(math.exp(5) / total) and r.speech == pytest.approx(math.exp(4) / total)
    assert r.applause == r.music == 0.0


@pytest.mark.parametrize("a,b,want", [([0., 0.], [1., 2.], 0), ([1., 2.], [1., 2.], 1), ([1., 0.], [0., 1.], 0), ([1., 0.], [-1., 0.], -1)])
def test_cosine(spark, a, b, want):
    r = spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(FT.cosine("a", "b").alias("c")).first().c
    assert r == pytest.approx(want, abs=1e-9)


def vecs(spark, rows):
    return spark.createDataFrame(rows, "episode_id bigint, window_id bigint, v array<float>")


def test_mean_vector(spark):
    df = vecs(spark, [(1, 0, [1., 0.]), (1, 1, [0., 1.]), (1, 2, [1., 1.]), (2, 0, [1.]), (2, 1, [1., 2.]), (3, 0, [])])
    got = {r.episode_id: r["mean"] for r in FT.mean_vector(df, ["episode_id"]).collect()}
    assert got[1] == pytest.approx([2 / 3, 2 / 3]) and got[2] is None and got[3] is None


def test_novelty(spark):
    df = vecs(spark, [(1, 0, [1., 0., 0.]), (1, 1, [1., 0., 0.]), (1, 2, [0., 1., 0.]), (2, 0, [3., 1.]), (3, 0, [1.]), (3, 1, [1., 2.])])
    got = {(r.episode_id, r.window_id): r.novelty for r in FT.novelty(df).collect()}
    assert got[(1, 2)] == 1 and got[(1, 0)] == 0 and got[(2, 0)] == 0 and got[(3, 0)] == got[(3, 1)] == 0
    assert len(got) == 6


def test_default_embedding(spark):
    e = FT.embed(spark.createDataFrame([("a b c",), ("a b d",), ("x y z",)], "t string"), "t", dim=64)
    assert all(len(r.v) == 64 for r in e.collect())
    up = F.pandas_udf(lambda s: s.map(lambda t: [float(len(t))]), "array<float>")
    assert FT.embed(spark.createDataFrame([("abc",)], "t string"), "t", fn=up).first().v == [3.0]


def test_quality_gate(spark):
    rows = [("We talked about it for a while and then left.", 10, 5.0, None), ("so สวัสดี then 안녕", 4, 2.0, "foreign-script"),
            ("Thank you very much. " * 5, 20, 10.0, "repeated-3-gram"), ("two words", 2, 60.0, "density"),
            ("Café déjà vu naïve", 4, 4.0, None), ("", 0, 60.0, None), ("one", 1, 3.0, None)]
    df = spark.createDataFrame([(1, i, *r[:3]) for i, r in enumerate(rows)],
                               "episode_id bigint, chunk_idx bigint, text string, n_words bigint, duration_s double")
    got = [r.reason for r in FT.flag_chunks(df).orderBy("chunk_idx").collect()]
    assert got == [r[3] for r in rows]
    good, bad = FT.usable_chunks(df)
    assert good.count() == 4 and bad.count() == 3
    strict = [r.reason for r in FT.flag_chunks(df, "strict").orderBy("chunk_idx").collect()]
    assert strict[3] == "density" and strict[6] is None       # 3 s is not above the strict bound
    assert [r.reason for r in FT.flag_chunks(df, "lax").orderBy("chunk_idx").collect()][3] is None


def test_candidates_keep_missing_signals_null(spark):
    w = windows(spark, (0, 20_000), (20_000, 40_000)).withColumn("transcript", F.lit("Honestly nobody talks about this.")).withColumn("word_count", F.lit(5))
    rms = spark.createDataFrame([(1, 0, -10.), (1, 10_000, -30.)], "episode_id bigint, t_ms bigint, rms_db double")
    got = {r.window_id: r for r in FT.build_candidates(w, rms=rms).collect()}
    assert got[0].rms_peak_db == -10 and got[0].linguistic.strong_claim == 2 and got[0].novelty is None
    assert got[1].rms_peak_db is None and got[1].audio_events is None


def test_signals_share_one_pass(spark):
    """All signals of a window at once: samples at both edges, spans across block borders and of no length."""
    w = windows(spark, (0, 60_000), (30_000, 90_000), (500_000, 510_000))
    rms = spark.createDataFrame([(1, 0, -10.), (1, 30_000, -20.), (1, 60_000, -90.), (1, 5, float("nan"))], "episode_id bigint, t_ms bigint, rms_db double")
    f0 = spark.createDataFrame([(1, 59_999, 100.), (1, 60_000, 300.), (1, 1, 0.)], "episode_id bigint, t_ms bigint, pitch_hz double")
    heard = spark.createDataFrame([(1, 10_000, 65_000, 1., 1., 1., 0.), (1, 60_000, 60_001, 3., 3., 3., 0.), (1, 45_000, 45_000, 5., 5., 5., None), (1, 500_000, 500_000, 9., 9., 9., 9.)],
                                  "episode_id bigint, start_ms bigint, end_ms bigint, laughter double, applause double, music double, speech double")
    both = FT.signal_features(w, rms, f0, heard)
    got = {r.window_id: r for r in both.collect()}
    for part in (FT.rms_features(w, rms), FT.f0_features(w, f0), FT.event_features(w, heard)):
        for r in part.collect():
            mine = got[r.window_id]
            assert all((mine.audio_events if c in FT.AUDIO_CLASSES else mine)[c] == r[c] for c in part.columns[2:])
    assert got[0].rms_mean_db == -15 and got[1].rms_mean_db == -55 and got[0].f0_peak_hz == 100 and got[1].f0_mean_hz == 200
    assert got[0].audio_events.music == 3 and got[1].audio_events.music == 3 and set(got) == {0, 1}
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()
    wide = FT.build_candidates(w.withColumns({"transcript": F.lit("a"), "word_count": F.lit(1)}), rms, f0, None, heard)
    assert wide._jdf.queryExecution().executedPlan().toString().count("Join") == 2      # three signals: six before


def test_left_points_keep_one_row_of_an_empty_interval(spark):
    w = windows(spark, (0, 90_000), (0, 90_001), (100_000, 160_000))
    p = spark.createDataFrame([(1, 90_000)], "episode_id bigint, t bigint")
    got = FT.point_in_interval(w, p, ["episode_id"], "start_ms", "end_ms", "t", 30_000, "left").select("window_id", "t").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(0, None), (1, None), (1, 90_000), (2, None)], key=repr)
