import json

from pyspark.sql import functions as F

from momentloom.operators import posting as P
from momentloom.operators import ranking as K
from momentloom.operators import reports as R
from momentloom.operators import trends as TR

RANKED = "episode_id string, candidate_index bigint, batch_idx bigint, pos bigint, score bigint, reasoning string, start_ms bigint, end_ms bigint"


def ranked(spark, scores, ep="e"):
    return spark.createDataFrame([(ep, i, i // 10, i % 10, s, f"r{i}", i * 1000, i * 1000 + 900) for i, s in enumerate(scores)], RANKED)


def order(df):
    return [(r.candidate_index, r.score) for r in df.orderBy("ord").collect()]


def test_top_k_is_stable(spark):
    assert order(K.top_k(ranked(spark, [50, 80, 65, 80]), 3)) == [(1, 80), (3, 80), (2, 65)]
    assert len(order(K.top_k(ranked(spark, [1] * 30), 5, 20))) == 20
    assert len(order(K.top_k(ranked(spark, [1] * 30), 0))) == 1


def test_blend_lanes(spark):
    top = K.top_k(ranked(spark, [80, 72, 60]), 3)
    second = spark.createDataFrame([("e", 0, 40, "dull"), ("e", 1, 90, "")], "episode_id string, candidate_index bigint, second bigint, why string")
    one = K.blend_lane(top, second, "vlm", n=2)
    assert order(one) == [(1, 81), (0, 60), (2, 60)]
    r = {x.candidate_index: x for x in one.collect()}
    assert r[0].reasoning == "r0 | vlm: dull" and r[1].reasoning == "r1" and r[2].vlm_score is None and r[1].vlm_reasoning is None
    two = K.blend_lane(one, spark.createDataFrame([("e", 2, 300, "x")], second.schema), "vlm_premium", n=3)
    assert order(two)[0] == (2, 100)
    assert {x.candidate_index: x.vlm_premium_score for x in two.collect()}[2] == 100
    out = K.finalize_clips(two.selectExpr("*", "'h' hook", "'t' trend_match", "'k' hook_type"), 2).orderBy("rank").collect()
    assert [(c.id, c.rank, c.status) for c in out] == [("e_clip_1", 1, "generated"), ("e_clip_2", 2, "generated")]


def test_rank_batches(spark):
    f = "struct(0L conflict_markers, 1L strong_claim, 0L confessional, 0L topic_shift, 0L questions, 0L numbers, 0L short_declaratives, array('q') quotable_lines) linguistic"
    c = spark.range(23).selectExpr(
        "'e' episode_id", "id * 3 window_id", "id start_ms", "id + 5 end_ms", "'t' transcript", f, *[f"cast(null as double) {n}" for n in (
            "rms_peak_db", "rms_mean_db", "f0_mean_hz", "f0_variance_hz2", "f0_peak_hz", "speaking_rate", "novelty")],
        "if(id = 0, named_struct('laughter', 0.5D), null) audio_events")
    got = {r.batch_idx: (r.n, json.loads(r.payload)) for r in K.rank_batches(c).collect()}
    assert [got[b][0] for b in (0, 1, 2)] == [10, 10, 3]
    first = got[0][1]
    assert [x["index"] for x in first] == list(range(10)) and got[1][1][0]["episode_index"] == 10
    assert first[0]["audio_events"] == {"laughter": .5} and "audio_events" not in first[1]
    assert first[1]["novelty"] is None and first[1]["prosody"]["rms_peak_db"] is None


CLIPS = "id string, job_id string, hook string, score double, start_ms bigint, end_ms bigint"
STATS = "clip_id string, platform string, fetched_at bigint, views bigint, ctr double, watch_pct double, likes bigint, reposts bigint, replies bigint"


def test_performance_history(spark):
    clips = spark.createDataFrame([(f"c{i}", "j", f"hook_{i}", 50.0 + i, 0, 60_000) for i in range(1, 9)] + [("n", "j", None, None, 0, 60_000)], CLIPS)
    stats = spark.createDataFrame([(f"c{i}", "x", 1, 100, 1.1 * i, None, None, None, None) for i in range(1, 9)], STATS)
    rows = R.performance_history(clips, stats).collect()
    best = [r.line for r in rows if r.side == "best"]
    worst = [r.line for r in rows if r.side == "worst"]
    assert len(best) == 5 and len(worst) == 3 and "hook_8" in best[0] and "hook_1" in worst[0]
    assert R.history_text(R.performance_history(clips, stats)).first().history.count("hook=") == 8
    one = spark.createDataFrame([("n", "x", 1, None, 3.45, None, None, None, None)], STATS)
    line = R.performance_history(clips, one).first().line
    assert 'hook="(no hook)"' in line and "ranker_score=?" in line and "CTR=3.45%" in line and "duration=60s" in line and "watch_pct=?" in line
    assert R.history_text(R.performance_history(clips, stats.limit(0))).first().history == ""


def test_worst_of_the_fetched_rows(spark):
    clips = spark.createDataFrame([(f"c{i:02}", "j", f"h{i}", 1.0, 0, 1) for i in range(30)], CLIPS)
    stats = spark.createDataFrame([(f"c{i:02}", "x", 1, 1, float(i), None, None, None, None) for i in range(30)], STATS)
    w = [r.hook for r in R.performance_history(clips, stats).filter("side = 'worst'").orderBy("idx").collect()]
    assert w == ["h12", "h13", "h14"]
    g = [r.hook for r in R.performance_history(clips, stats, global_worst=True).filter("side = 'worst'").orderBy("idx").collect()]
    assert g == ["h0", "h1", "h2"]


def test_posts_due(spark):
    now, h = 10_000_000, 3600
    posts = spark.createDataFrame([("a", "x", "posted", "i", now - 24 * h), ("b", "x", "posted", "i", now - h), ("c", "x", "posted", "", now - 24 * h),
                                   ("d", "x", "failed", "i", now - 24 * h), ("e", "x", "posted", "i", now - 72 * h - 2 * h)],
                                  "clip_id string, platform string, status string, external_id string, posted_at bigint")
    none = spark.createDataFrame([], STATS)
    due = sorted((r.clip_id, r.age_s) for r in R.posts_due(posts, none, now).collect())
    assert due == [("a", 24 * h), ("e", 72 * h)]
    seen = spark.createDataFrame([("a", "x", now + 60, 1, None, None, None, None, None), ("e", "y", now, 1, None, None, None, None, None)], STATS)
    assert [r.clip_id for r in R.posts_due(posts, seen, now).collect()] == ["e"]


def test_summary_line(spark):
    s = spark.createDataFrame([("c", "x", 0, 500, 4.2, 65.0, 25, None, None), ("c", "y", 5, None, None, None, None, None, None)], STATS)
    text = R.analytics_summary(s, 7200).first().summary
    assert "500 views" in text and "25 likes" in text and "4.2% CTR" in text and "65% watch" in text and "fetched 2h ago" in text and "y (" not in text


def test_costs(spark):
    u = spark.createDataFrame([("j", "chat", "gpt-4o-mini", 1000, 200, 0.0, 0), ("j", "chat", "gpt-4o-mini", 500, 100, 0.0, 0),
                               ("j", "stt", "whisper-large-v3", 9, 9, 30.0, 0), ("j", "embeddings", "bge-m3", 9, 9, 0.0, 4003)],
                              "job_id string, category string, model string, input_tokens bigint, output_tokens bigint, audio_s double, chars bigint")
    got = {r.category: r for r in R.cost_by_category(u).collect()}
    assert (got["chat"].calls, got["chat"].input_tokens, got["chat"].output_tokens) == (2, 1500, 300)
    assert got["stt"].input_tokens == 750 and got["embeddings"].input_tokens == 1000 and got["stt"].output_tokens == 0
    assert abs(got["chat"].cost_cents - (1500 * .0025 + 300 * .01) / 10) < 1e-9
    assert R.job_cost(R.cost_by_category(u)).first().calls == 4


def test_rates_prefer_the_first_rule(spark):
    names = ["whisper-1", "whisper-large-v3-turbo", "my-whisper", "gpt-5.2-pro-x", "gpt-4-turbo", "x-embed", "z", "Qwen3-VL-8B-I"]
    df = spark.createDataFrame([(n,) for n in names], "m string").select("m", R.rate_for(F.col("m")).alias("r"))
    got = {r.m: r.r.in_rate for r in df.collect()}
    assert got == {"whisper-1": .004, "whisper-large-v3-turbo": .000444, "my-whisper": .00123, "gpt-5.2-pro-x": .002, "gpt-4-turbo": .01,
                   "x-embed": .0001, "z": .001, "Qwen3-VL-8B-I": .0003}


def test_loudness_merge(spark):
    a = spark.createDataFrame([("s", -20.0, 1), ("s", -10.0, 5)], "show_slug string, lufs double, measured_at bigint")
    first = R.show_loudness(a)
    assert tuple(first.first()) == ("s", -15.0, 5, 2)
    more = spark.createDataFrame([("s", -30.0, 9)], a.schema)
    assert tuple(R.merge_show_loudness(first, more).first()) == ("s", -20.0, 9, 3)


def test_daily_views_keeps_days_of_other_platforms(spark):
    s = spark.createDataFrame([("c", "youtube", 86_400, 5, None, None, None, None, None), ("c", "tiktok", 2 * 86_400, 9, None, None, None, None, None)], STATS)
    assert sorted(tuple(r) for r in R.daily_views(s, 3 * 86_400).collect()) == [("1970-01-02", 5, 0, 0, 0), ("1970-01-03", 0, 0, 0, 0)]


def test_latest_only_board(spark):
    jobs = spark.createDataFrame([("a", "done", 1, None), ("b", "failed", 2, None)], "id string, status string, updated_at bigint, error string")
    got = R.stage_board(jobs, latest_only=True).orderBy("stage_idx").collect()
    assert [r.stage_status for r in got] == ["error"] + ["idle"] * 7


TREND = "source string, topic_id string, label string, score double, fetched_at bigint"


def test_trends(spark):
    t = spark.createDataFrame([("a", "1", "x", 90.0, 5), ("a", "2", "y", 70.0, 5), ("b", "3", "z", 50.0, 9), ("a", "1", "x", 10.0, 1)], TREND)
    assert [r.score for r in TR.recent_trends(t, 2).collect()] == [90, 70]
    assert TR.recent_trends(t, 0).count() == 0
    assert TR.latest_batch(t).count() == 3
    f = {r.source: r.fresh for r in TR.source_freshness(t, 86_400 + 8, ["a", "b", "c"]).collect()}
    assert f == {"a": False, "b": True, "c": False}


def test_prompt_context(spark):
    eps = spark.createDataFrame([("e", "s"), ("f", None)], "episode_id string, show_slug string")
    t = spark.createDataFrame([("a", "1", None, 89.6, 5), ("a", "2", "y", 70.0, 5)], TREND)
    pri = spark.createDataFrame([("s", " one \n\n two")], "show_slug string, content string")
    hist = spark.createDataFrame([("H",)], "history string")
    got = {r.episode_id: r for r in K.prompt_context(eps, t, pri, hist).collect()}
    assert got["f"].current_trends.endswith("- 1 (score: 90) [a]\n- y (score: 70) [a]") and got["f"].performance_history == "H"
    assert got["e"].current_trends.endswith("[a]\n\nShow topic priors:\n- one\n- two")
    unrated = t.union(spark.createDataFrame([("a", "3", "z", None, 5)], TREND))
    assert {r.episode_id: r for r in K.prompt_context(eps, unrated, pri, hist).collect()}["f"].current_trends.endswith("- y (score: 70) [a]\n- z [a]")
    empty = {r.episode_id: r.current_trends for r in K.prompt_context(eps, t.limit(0), pri, hist).collect()}
    assert empty["f"] == "" and "topic priors" in empty["e"]


# -- posting --

def test_plan_and_quota(spark):
    clips = spark.createDataFrame([("a",), ("b",), ("c",)], "clip_id string")
    rend = spark.createDataFrame([("a", "9x16"), ("b", "1x1"), ("c", "9x16")], "clip_id string, variant string")
    copy = spark.createDataFrame([("a",), ("b",)], "clip_id string")
    got = {(r.clip_id, r.platform): (r.status, r.reason) for r in P.plan_posts(clips, rend, copy, ["x", "youtube"]).collect()}
    assert got[("a", "x")] == ("pending", None) and got[("b", "x")] == ("skipped", "9x16 variant missing")
    assert got[("c", "youtube")] == ("skipped", "no social copy for this clip") and len(got) == 6
    plan = spark.createDataFrame([(i, "acc", 1000 + i if i < 9 else 90_000) for i in range(10)], "plan_id int, account string, planned_at bigint")
    ok = {r.plan_id: r.admitted for r in P.admit_by_quota(plan).collect()}
    assert sorted(i for i in ok if ok[i]) == [0, 1, 2, 3, 4, 5, 9]
    assert sum(r.admitted for r in P.admit_by_quota(plan, 1, 2).collect()) == 3


def test_compose(spark):
    copy = {"youtube_shorts": {"title": "T" * 120, "description": "d", "hashtags": ["a"]}, "x": {"text": "y" * 300, "hashtags": []},
            "instagram_reels": {"caption": "cap #one", "hashtags": ["one", "two"]}, "bluesky": {"text": "", "hashtags": ["#b", "c"]},
            "threads": {"text": " t ", "hashtags": ["##q", " "]}}
    df = P.parse_copy(spark.createDataFrame([("c", json.dumps(copy))], "clip_id string, social_copy_json string"))
    got = {r.platform: r for r in P.compose_posts(df).collect()}
    assert len(got["youtube"].title) == 100 and got["youtube"].text == "d\n#Shorts"
    assert len(got["x"].text) == 280 and got["x"].text.endswith("…")
    assert got["instagram"].text == "cap #one\n\n#two" and got["ayrshare"].text == "cap #one\n\n#two"
    assert got["bluesky"].text == "#b #c" and got["threads"].text == "t\n\n#q" and got["linkedin"].text == ""


def test_vetoes(spark):
    d = spark.createDataFrame([("m", "e", "clip_03"), ("m", "e", "clip_9")], "message_id string, episode_id string, label string")
    clips = spark.createDataFrame([("e", 3, "c3")], "episode_id string, rank bigint, clip_id string")
    posts = spark.createDataFrame([("c3", "x", "posted", "i"), ("c3", "y", "vetoed", None), ("c3", "z", "posted", None), ("c3", "w", "posted", "i")],
                                  "clip_id string, platform string, status string, external_id string")
    out = P.resolve_vetoes(d, clips, posts, ["x", "y", "z"])
    assert {(r.platform, r.detail) for r in out.collect()} == {
        ("x", "to remove"), ("y", "already vetoed"), ("z", "no external_id recorded"), ("w", "platform not configured"), ("all", "clip 'clip_9' not found in database")}
    text = P.veto_confirmation(out).first().text
    assert text.startswith("Veto results:\n\nclip_03:\n") and "  [OK] x: removed\n" in text and "[FAIL] all: clip 'clip_9'" in text


def test_ranks_of_one_score_only(spark):
    """Ranges are cut inside the score that every row has."""
    ranked = spark.range(4_000).select(F.lit(1).alias("episode_id"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("candidate_index"), F.lit(50).cast("bigint").alias("llm_score"),
                                       (F.col("id") % 3).alias("vlm_score"))
    got = R.rank_delta(ranked.repartition(8)).collect()
    by = sorted(got, key=lambda r: r.candidate_index)
    assert [r.first_rank for r in by] == list(range(1, 4_001))
    second = sorted(got, key=lambda r: (-r.vlm_score, r.candidate_index))
    assert [r.second_rank for r in second] == list(range(1, 4_001)) and all(r.rank_delta == r.first_rank - r.second_rank for r in got)


def test_analytics_summary_by_day(spark):
    day = 86_400
    rows = [("c", "x", t, v, None, None, None, None, None) for t, v in ((3 * day, 3), (5, 1), (day + 9, 2), (6, None))]
    a = spark.createDataFrame(rows, "clip_id string, platform string, fetched_at bigint, views bigint, likes bigint, reposts bigint, replies bigint, ctr double, watch_pct double")
    got = R.analytics_summary(a, 3 * day).first().summary
    assert got == "## Analytics\n\n  x (fetched 71h ago): 1 views\n  x (fetched 47h ago): 2 views\n  x (just now): 3 views\n"


def test_clip_details_moves_children_once(spark):
    """Children are not gathered before they have moved (a map task would sort and spill all of them)."""
    clips = spark.createDataFrame([("a", 1, "ok"), ("b", 1, "ok"), ("c", 9, "ok"), (None, 1, "ok"), ("d", 1, "no")], "id string, job_id bigint, status string")
    jobs = spark.createDataFrame([(1, "s", "done")], "id bigint, show_slug string, status string")
    renders = spark.createDataFrame([("a", "9x16", "p", None, 1, 2), ("a", "1x1", "q", "u", 1, 2), (None, "1x1", "r", "u", 1, 2), ("z", "1x1", "r", "u", 1, 2)],
                                    "clip_id string, variant string, path string, url string, bytes bigint, duration_ms bigint")
    posts = spark.createDataFrame([("b", "x", "posted", "7", 5), ("d", "x", "posted", "8", 5)], "clip_id string, platform string, status string, external_id string, posted_at bigint")
    out = R.clip_details(clips, jobs, renders, posts, status="ok")
    got = {r.clip_id: r for r in out.collect()}
    assert set(got) == {"a", "b", "c", None} and out.count() == 4
    assert [v.path for v in got["a"].renders] == ["q", "p"] and got["a"].posts == [] and got["a"].job_status == "done"
    assert got["b"].posts[0].external_id == "7" and got["b"].posts[0].error is None and got["b"].renders == []
    assert got["c"].job_status is None and got[None].renders == [] and got[None].posts == []
    slim = R.clip_details(clips, jobs, renders, posts, render_fields=("variant",), post_fields=("platform",))
    assert slim.schema["renders"].dataType.elementType.names == ["variant"] and slim.count() == 5
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_clip_details_by_job_lie_where_manifests_join(spark):
    """The same rows as dealt by clip; the enrichment moves them no more, and a table not shown does not move."""
    clips = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 9, 1), (None, 1, 1), ("d", None, 1)], "id string, job_id bigint, rank bigint")
    jobs = spark.createDataFrame([(1, "s", "done")], "id bigint, show_slug string, status string")
    renders = spark.createDataFrame([("a", 1, "9x16", "/w/clipper/p", None, 1, 2), ("a", 1, "1x1", "q", "u", 1, 2), ("c", 9, "1x1", "r", "u", 1, 2)],
                                    "clip_id string, job_id bigint, variant string, path string, url string, bytes bigint, duration_ms bigint")
    posts = spark.createDataFrame([("b", 1, "x", "posted", "7", 5)], "clip_id string, job_id bigint, platform string, status string, external_id string, posted_at bigint")
    by_clip, by_job = (R.clip_details(clips, jobs, renders, posts, by_job=way) for way in (False, True))
    assert sorted(map(tuple, by_clip.collect()), key=repr) == sorted(map(tuple, by_job.collect()), key=repr)
    known = spark.createDataFrame([(1, 1, 1, "second"), (1, 1, 0, "first"), (1, 2, 2, "bare"), (9, 2, 0, "no")], "episode_id bigint, rank bigint, pos int, hook_source string").selectExpr(
        "*", "CAST(NULL AS STRING) AS social", "'' AS overlay_hook", "named_struct('blended', 1L) AS scores", "named_struct('abs_path', '/w/clipper/c.jpg') AS cover_frame", "array('w') AS words")
    slim = R.clip_details(clips, jobs, renders, posts, post_fields=(), by_job=True)
    out = R.enrich_clips(slim, known, "/w")
    assert {r.clip_id: (r.hook_source, r.has_words, r.cover_url, len(r.variants)) for r in out.collect()} == {
        "a": ("first", True, "/media/clipper/c.jpg", 2), "b": (None, False, None, 0), "c": (None, False, None, 1), None: (None, False, None, 0), "d": (None, False, None, 0)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 3 and "platform" not in plan     # details, jobs and manifests, each once
