import json

import pytest
from pyspark.sql import functions as F

from momentloom.operators import ranking
from momentloom.sinks import tables as S
from momentloom.sources import feeds, logs, messages

LINES = "episode_id string, part bigint, ord bigint, line string"


def lines(spark, text, part=2):
    return spark.createDataFrame([("e", i // part, i, x) for i, x in enumerate(text.strip().splitlines())], LINES)


def test_silence_log(spark, rows):
    text = """[d @ 1] silence_start: -0.5
[d @ 1] silence_end: 1.5 | silence_duration: 2.0
noise
silence_end: 1.9
silence_start: 2
silence_start: 2.5
other
more
silence_end: 4.0
silence_start: 9"""
    assert rows(logs.read_silence_log(lines(spark, text)), "start_ms", "end_ms") == [(0, 1500), (2500, 4000)]


def test_shot_log(spark):
    text = "n:0 pts_time:5.123456 x\nn:1 pts_time:12.5 y\nn:2 pts_time:5.123456 z\njunk"
    assert sorted(r.t_ms for r in logs.read_shot_log(lines(spark, text)).collect()) == [5123, 12_500]


def test_level_log(spark, rows):
    text = """lavfi.astats.Overall.RMS_level=-1
frame:0 pts:0 pts_time:0
lavfi.astats.1.RMS_level=-99
lavfi.astats.Overall.RMS_level=-23.5
frame:1 pts:1 pts_time:1
lavfi.astats.Overall.RMS_level=-inf
lavfi.astats.1.RMS_level=-3
frame:2 pts:2 pts_time:-2
lavfi.astats.1.RMS_level=-20
lavfi.astats.2.RMS_level=-40"""
    assert rows(logs.read_level_log(lines(spark, text)), "t_ms", "rms_db") == [(0, -20.0), (0, -23.5)]


def test_pitch_log(spark, rows):
    text = "0.0 100\n0.5\t-4\n\nnan 7\n1.0 inf\nbad\n 1.5   220.5"
    assert rows(logs.read_pitch_log(lines(spark, text)), "t_ms", "pitch_hz") == [(0, 100.0), (1500, 220.5), (500, 0.0)]


def test_log_directory(spark, tmp_path, rows):
    for name in ("a", "b"):
        (tmp_path / f"{name}.log").write_text("silence_start: 1\nsilence_end: 2\n")
    got = logs.read_silence_log(logs.read_log_lines(spark, str(tmp_path)))
    assert rows(got) == [("a", 1000, 2000), ("b", 1000, 2000)]


def test_seen_ids(spark, rows):
    jobs = spark.createDataFrame([("a",)], "id string")
    got = logs.import_seen_ids(lines(spark, " a \nb\n\n\tb\nc"), jobs, 7)
    assert rows(got, "id", "status", "created_at") == [("b", "done", 7), ("c", "done", 7)]


def test_transcripts(spark, rows):
    full = json.dumps({"text": "hi you", "segments": [{"id": 1, "start": 0, "end": 1, "text": "hi you"}], "words": [
        {"word": "hi", "start": 0, "end": .4}, {"word": "you", "start": None}], "other": 1})
    df = spark.createDataFrame([("e", 0, 1000, full), ("e", 1, 0, '{"text":"x","segments":null}'), ("e", 2, 0, "broken"), ("e", 3, 0, None)],
                               "episode_id string, chunk_idx bigint, offset_ms bigint, json string")
    w, s = feeds.read_transcripts(df)
    assert rows(w, "text", "start_ms", "end_ms") == [("hi", 1000, 1400), ("you", 1000, 1000)]
    # The answer without segments gets one for its minute.
    assert rows(s, "start_ms", "text") == [(0, "x"), (1000, "hi you")]


def feed(spark, kind, body):
    df = spark.createDataFrame([("f", body if isinstance(body, str) else json.dumps(body))], "feed_id string, body string")
    return [tuple(r)[1:] for r in feeds.read_trend_feed(df, kind).collect()]


def test_trend_feeds(spark):
    assert feed(spark, "news", {"articles": [{"url": "u", "title": "A"}, {"url": "", "title": "B"}]}) == [
        ("gdelt", "u", "A", 1.0), ("gdelt", "gdelt_1", "B", 1 - 1 / 30)]
    posts = [{"data": {"id": str(i), "subreddit": "s", "title": "t", "score": n}} for i, n in enumerate([50, -3, 100])]
    assert [r[3] for r in feed(spark, "forum", {"data": {"children": posts}})] == [.5, 0.0, 1.0]
    assert feed(spark, "forum", {"data": {"children": posts[:1]}})[0][:3] == ("reddit", "reddit_0", "r/s: t")
    day = {"trendingSearches": [{"title": {"query": f"q{i}"}} for i in range(25)]}
    got = feed(spark, "searches", ")]}'\n" + json.dumps({"default": {"trendingSearchesDays": [day, day]}}))
    assert len(got) == 50 and got[0][3] == got[25][3] == 1.0 and got[24][3] == pytest.approx(.05)
    story = {"storySummaries": {"trendingStories": [{"title": "", "entityNames": ["A", "B"]}, {"title": ""}, {"title": "T"}]}}
    assert [r[1:3] for r in feed(spark, "searches", story)] == [("google_story_0", "A, B"), ("google_story_2", "T")]
    assert feed(spark, "news", "oops") == feed(spark, "forum", "oops") == feed(spark, "searches", "oops") == []


def test_rank_responses(spark):
    cands = spark.createDataFrame([("e", i, i * 60_000, i * 60_000 + 60_000) for i in range(12)],
                                  "episode_id string, candidate_index bigint, start_ms bigint, end_ms bigint")
    clips = [{"index": 1, "score": 150, "hook": " h ", "refined_start_secs": 30, "refined_end_secs": 200, "hook_type": " Bold ", "trend_match": " "},
             {"index": 10, "score": -5}, {"index": 11, "score": 7}, {"index": 99, "score": 1}]
    df = spark.createDataFrame([("e", 0, json.dumps({"clips": clips}))], "episode_id string, batch_idx bigint, response string")
    got = {r.candidate_index: r for r in feeds.read_rank_responses(df, cands).collect()}
    assert set(got) == {1, 10, 11}
    assert (got[1].score, got[1].hook, got[1].hook_type, got[1].trend_match) == (100, "h", "bold", None)
    assert (got[1].start_ms, got[1].end_ms) == (55_000, 125_000)
    assert got[10].score == 0
    assert {r.candidate_index for r in feeds.read_rank_responses(df, cands, strict=True).collect()} == {1}


def test_candidates_are_not_broadcast(spark, tmp_path):
    """A file of candidates may be below the size check while its rows fill the driver."""
    path = str(tmp_path / "c")
    spark.range(1000).selectExpr("id % 7 AS episode_id", "id AS candidate_index", "id AS start_ms", "id + 9 AS end_ms").write.parquet(path)
    df = spark.createDataFrame([(0, 0, '{"clips": []}')], "episode_id bigint, batch_idx bigint, response string")
    hit = feeds.read_rank_responses(df, spark.read.parquet(path))
    lane = ranking.blend_lane(hit.withColumn("ord", F.lit(1)), spark.read.parquet(path).selectExpr("episode_id", "candidate_index", "1 AS second", "'' AS why"))
    for out in (hit, lane):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def refined(spark, s, e, a, b):
    c = feeds.clamp_refined(*[F.lit(x) for x in (s, e, a, b)])
    return tuple(spark.range(1).select(*c).first())


def test_refinement(spark):
    assert refined(spark, 60_000, 120_000, 30_000, 200_000) == (55_000, 125_000)
    assert refined(spark, 60_000, 120_000, 62_000, 118_000) == (62_000, 118_000)
    assert refined(spark, 60_000, 66_000, 70_000, 60_000) == (65_000, 66_000)
    assert refined(spark, 2_000, 3_000, 0, 0) == (0, 3_000)


def test_post_stats(spark):
    def one(kind, body):
        df = spark.createDataFrame([("c", "p", 1, body)], "clip_id string, platform string, fetched_at bigint, body string")
        return tuple(feeds.read_post_stats(df, kind).first())[3:]
    assert one("video", '{"items":[{"statistics":{"viewCount":"500","likeCount":"x","commentCount":"3"}}]}') == (500, None, None, None, None, 3)
    assert one("video", '{"items":[]}') == (None,) * 6
    assert one("thread", '{"thread":{"post":{"likeCount":4,"repostCount":5}}}') == (None, None, None, 4, 5, None)


def test_params(spark):
    def one(cfg):
        df = spark.createDataFrame([(1, cfg if cfg is None or isinstance(cfg, str) else json.dumps(cfg))], "id int, config_json string")
        return feeds.resolve_params(df).first()
    d = one(None)
    assert (d.clip_top_k, d.clip_min_secs, d.clip_max_secs, d.clip_target_secs) == (5, 10.0, 30.0, 20.0)
    assert one("{bad")[2:] == one("")[2:] == d[2:]
    r = one({"clip_top_k": 0, "clip_min_secs": 1, "clip_max_secs": 2, "clip_target_secs": 99, "clip_stride_secs": -1,
             "clip_video_crf": 80, "clip_audio_bitrate_kbps": 8, "clip_video_preset": " ", "asd_enabled": True, "post_enabled_platforms": ""})
    assert (r.clip_top_k, r.clip_min_secs, r.clip_max_secs, r.clip_target_secs, r.clip_stride_secs) == (1, 5.0, 6.0, 6.0, 15.0)
    assert (r.clip_video_crf, r.clip_audio_bitrate_kbps, r.clip_video_preset, r.asd_enabled) == (51, 32, "medium", True)
    w = one({"clip_top_k": "9", "clip_min_secs": "x", "clip_video_crf": -4, "vlm_rerank_enabled": 1, "clip_min_words": 2.5})
    assert (w.clip_top_k, w.clip_min_secs, w.clip_video_crf, w.vlm_rerank_enabled, w.clip_min_words) == (5, 10.0, 18, False, 15)


def test_links(spark):
    def ids(body):
        return messages.extract_link_ids(spark.createDataFrame([(body,)], "body string")).first().link_ids
    i = "1AbCdEfGhIjKlMn"
    assert ids(f"https://drive.google.com/file/d/{i}/view") == [i]
    assert ids(f"https://drive.google.com/open?id={i} again /file/d/{i}") == [i]
    assert ids(f"https://www.google.com/url?q=https%3A%2F%2Fdrive.google.com%2Ffile%2Fd%2F{i}%2Fview&amp;sa=D") == [i]
    assert ids("https://www.google.com/url?q=%zz bad") == [] and ids("nothing") == []


def test_directives(spark):
    def labels(body):
        return messages.extract_directives(spark.createDataFrame([(body,)], "body string")).first().labels
    assert labels("veto: clip_07\nVETO:clip_03 veto:  Clip_07") == ["clip_03", "clip_07"]
    assert labels("keep clip_01") == [] and labels("unveto: clip_1") == []


# -- sinks --

def test_upsert(spark, rows):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, x string, y int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, x string, v int")
    once = S.upsert(old, new, ["id"], "v")
    assert rows(once) == [(1, "a", 5), (2, "d", None), (3, "e", None)]
    assert rows(S.upsert(once, new, ["id"], "v")) == rows(once)
    part = S.update_columns(old, spark.createDataFrame([(2, "z")], "id int, x string"), ["id"])
    assert rows(part) == [(1, "a", 5), (2, "z", 6)]


def test_bulk_action(spark, rows):
    clips = spark.createDataFrame([("a", "generated"), ("b", "generated")], "clip_id string, status string")
    ids = spark.createDataFrame([("a",), ("a",)], "clip_id string")
    changed, posts = S.bulk_action(clips, ids, "post", ["x:main", "threads"])
    assert rows(changed) == [("a", "posted"), ("b", "generated")]
    assert rows(posts) == [("a", "threads", "pending"), ("a", "x:main", "pending")]
    assert S.bulk_action(clips, ids, "veto")[1] is None
    with pytest.raises(ValueError):
        S.bulk_action(clips, ids, "burn")


def test_trend_append_and_prune(spark, tmp_path):
    path = str(tmp_path / "trends")
    batch = spark.createDataFrame([("s", "t", "old", 9.0, 0), ("s", "t", "L", 1.0, 1), ("s", "u", "M", 2.0, 2)],
                                  "source string, topic_id string, label string, score double, pos int")
    for at in (100_000, 100_000, 200_000):
        S.append_trends(batch, path, at)
    table = spark.read.parquet(path)
    assert table.count() == 4
    assert {(r.topic_id, r.label, r.score) for r in table.collect()} == {("t", "L", 1.0), ("u", "M", 2.0)}
    assert S.prune_trends(table, 200_000, 50_000).count() == 2
    assert S.prune_partitions(path, spark, 200_000, 50_000) == 1
    assert {r.fetched_at for r in spark.read.parquet(path).collect()} == {200_000}


def test_manifest_and_digest(spark, tmp_path):
    none = "cast(null as bigint)"
    clips = spark.createDataFrame([("e", "c2", 2, 70, 0, 61_000, "Hook"), ("e", "c1", 1, 90, 5000, 20_000, "")],
                                  "episode_id string, clip_id string, rank bigint, score bigint, start_ms bigint, end_ms bigint, hook string")
    clips = clips.selectExpr("*", "'why' reasoning", "'t' hook_type", "score llm_score", f"{none} vlm_score", "cast(null as string) vlm_reasoning",
                             f"{none} vlm_premium_score", "cast(null as string) vlm_premium_reasoning")
    renders = spark.createDataFrame([("c1", "9x16", "/w/a.mp4", 1048576)], "clip_id string, variant string, path string, bytes bigint")
    posts = spark.createDataFrame([("c1", "x", "failed", None, None, "no luck")], "clip_id string, platform string, status string, external_url string, external_id string, error string")
    words = spark.createDataFrame([("c1", 0, "hi", 0, 500)], "clip_id string, pos bigint, text string, start_ms bigint, end_ms bigint")
    eps = spark.createDataFrame([("e", "ep.mp4", 3_725_000)], "episode_id string, media_name string, total_ms bigint")
    costs = spark.createDataFrame([("e", "chat", 2, 1500, 300, 1.25)], "episode_id string, category string, calls bigint, input_tokens bigint, output_tokens bigint, cost_cents double")
    rows = S.manifests(S.clip_documents(clips, renders, posts, words), eps, costs)
    doc = json.loads(rows.first().manifest)
    assert doc["schema_version"] == 4 and [c["rank"] for c in doc["clips"]] == [1, 2] and doc["cost"]["total_calls"] == 2
    assert doc["clips"][0]["variants"][0]["filename"] == "a.mp4" and doc["clips"][0]["words"][0] == {"text": "hi", "start_secs": 0.0, "end_secs": 0.5}
    S.write_manifests(rows, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    files = [f.name for f in (tmp_path / "m").glob("bucket=*/part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)      # the keys of a document are most of its text
    text = S.episode_digest(clips, renders, posts, eps, costs).first().digest
    assert "Total duration: 1h 02m 05s\nClips produced: 2\n" in text and "## Clip 01  score 90  00:05-00:20  (15s)\n" in text
    assert text.index("Clip 01") < text.index("Clip 02") and "[FAILED ] x          no luck" in text and "    [9x16]  1.0MB  /w/a.mp4\n" in text
    assert "  Chat/LLM         2 calls      1500 in       300 out  $0.0125\n" in text


def test_children_that_name_their_episode_move_once(spark):
    """The same manifests as by clip, and one exchange less for each child."""
    clips = spark.createDataFrame([("e", "a", 1), ("e", "b", 2), ("f", "c", 1), ("f", None, 2)], "episode_id string, clip_id string, rank bigint").selectExpr(
        "*", "9L AS score", "0L AS start_ms", "1000L AS end_ms", "'h' AS hook", "'t' AS hook_type", "9L AS llm_score", "NULL AS vlm_score", "NULL AS vlm_reasoning",
        "NULL AS vlm_premium_score", "NULL AS vlm_premium_reasoning", "'r' AS reasoning")
    of = {"a": "e", "b": "e", "c": "f"}
    made = lambda rows, schema: spark.createDataFrame([(of.get(r[0], "e"), *r) for r in rows], "episode_id string, " + schema)
    renders = made([("a", "9x16", "/w/a.mp4", 5), ("a", "1x1", "/w/b.mp4", 6), (None, "1x1", "/w/n.mp4", 7), ("gone", "1x1", "/w/g.mp4", 8)], "clip_id string, variant string, path string, bytes bigint")
    posts = made([("c", "x", "posted")], "clip_id string, platform string, status string")
    words = made([("b", 1, "two", 5, 9), ("b", 0, "one", 0, 4)], "clip_id string, pos int, text string, start_ms bigint, end_ms bigint")
    eps = spark.createDataFrame([("e", "m", 1), ("f", "m", 1), ("g", "m", 1)], "episode_id string, media_name string, total_ms bigint")
    once = S.manifests(S.clip_documents(clips, renders, posts, words), eps)
    by_clip = S.manifests(S.clip_documents(clips, *[d.drop("episode_id") for d in (renders, posts, words)]), eps)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, by_clip.collect()))
    sent = posts.selectExpr("*", "'u' AS external_url", "'i' AS external_id", "'' AS error")
    digests = S.episode_digest(clips, renders, sent, eps)
    apart = S.episode_digest(clips, *[d.drop("episode_id") for d in (renders, sent)], eps)
    assert sorted(map(tuple, digests.collect())) == sorted(map(tuple, apart.collect()))
    moved = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")
    assert moved(once) < moved(by_clip)
    assert moved(digests) < moved(apart)


def _episode_tables(spark):
    clips = spark.createDataFrame([("e", "a", 2), ("e", "b", 1), ("f", "a", 1), ("e", "b", 1), ("f", None, 2), (None, "a", 1), ("gone", "a", 1)], "episode_id string, clip_id string, rank bigint").selectExpr(
        "*", "9L AS score", "0L AS start_ms", "1000L * rank AS end_ms", "if(rank = 1, 'h', NULL) AS hook", "'t' AS hook_type", "9L AS llm_score", "CAST(NULL AS BIGINT) AS vlm_score",
        "CAST(NULL AS STRING) AS vlm_reasoning", "CAST(NULL AS BIGINT) AS vlm_premium_score", "CAST(NULL AS STRING) AS vlm_premium_reasoning", "'r' AS reasoning", "if(rank = 1, concat('/w/', clip_id, '.jpg'), NULL) AS cover_path")
    made = lambda rows, schema: spark.createDataFrame(rows, "episode_id string, clip_id string, " + schema)
    renders = made([("e", "a", "9x16", "/w/a.mp4", 5), ("e", "a", "1x1", "/w/b.mp4", 6), ("e", None, "1x1", "/w/n.mp4", 7), ("e", "gone", "1x1", "/w/g.mp4", 8), ("f", "a", "1x1", "/w/f.mp4", 9)], "variant string, path string, bytes bigint")
    posts = made([("e", "b", "x", "posted", "u"), ("e", "b", "threads", "failed", None), (None, "a", "x", "posted", "u")], "platform string, status string, external_url string").selectExpr("*", "'i' AS external_id", "'no' AS error")
    words = made([("e", "b", 1, "two", 5, 9), ("e", "b", 0, "one", 0, 4), ("f", "a", 0, None, 0, 4)], "pos int, text string, start_ms bigint, end_ms bigint")
    texts = ",".join(f"'{p}', named_struct({','.join(f"'{f}', 'T {p}'" for f in fs)}, 'hashtags', array('#x'))" for p, fs in S.SOCIAL_TEXTS.items())
    social = made([("e", "a", 1), ("e", "a", 2), ("f", "a", 3)], "n int").selectExpr("episode_id", "clip_id", f"named_struct({texts}, 'overlay_hook', 'over', 'hook_source', string(n)) AS social")
    eps = spark.createDataFrame([("e", "m", 1), ("f", "m", 1), ("g", "m", 3_700_000), ("g", "again", 1), (None, "no id", 1)], "episode_id string, media_name string, total_ms bigint")
    costs = spark.createDataFrame([("e", "chat", 2, 15, 3, 1.25), ("e", "stt", 1, 5, 0, 0.5), ("f", "vlm", 0, 0, 0, 0.0)], "episode_id string, category string, calls bigint, input_tokens bigint, output_tokens bigint, cost_cents double")
    return clips, renders, posts, words, social, eps, costs


@pytest.mark.parametrize("pack_bytes, bucket_rows", [(1 << 20, 100), (1, 1)])
def test_packed_episodes_are_those_joined_by_clip(spark, monkeypatch, pack_bytes, bucket_rows):
    """Copies of a clip, two social blocks, null and unknown keys, episodes without clips; one move of all rows."""
    from momentloom.operators import packed

    monkeypatch.setattr(packed, "PACK_BYTES", pack_bytes)
    monkeypatch.setattr(packed, "BUCKET_ROWS", bucket_rows)
    clips, renders, posts, words, social, eps, costs = _episode_tables(spark)
    for block in (social, None):
        for spent in (costs, None):
            got = S.episode_manifests(clips, renders, posts, words, eps, spent, block, as_of=7)
            want = S.manifests(S.clip_documents(clips, renders, posts, words, block), eps, spent, as_of=7)
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
            alone = clips.filter("episode_id = 'e'"), *[d.filter("episode_id = 'e'") for d in (renders, posts)]
            said = None if block is None else block.filter("episode_id = 'e'")
            told = S.episode_digest(*alone, eps, spent, said)
            apart = S.episode_digest(alone[0], *[d.drop("episode_id") for d in alone[1:]], eps, spent, None if said is None else said.drop("episode_id"))
            assert sorted(map(tuple, told.collect()), key=repr) == sorted(map(tuple, apart.collect()), key=repr)
            for moved in (got, told):
                assert moved._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_packed_episodes_lie_in_the_folders_they_are_written_to(spark, tmp_path, monkeypatch):
    """A task has whole folders or a part of one, so it does not write a file into each."""
    from momentloom.operators import packed

    monkeypatch.setattr(packed, "BUCKET_ROWS", 20)
    clips, renders, posts, words, social, eps, _ = _episode_tables(spark)
    many = lambda df: df.filter("episode_id = 'e'").drop("episode_id").crossJoin(spark.range(200).selectExpr("string(id) AS episode_id"))
    S.write_manifests(S.episode_manifests(many(clips), many(renders), many(posts), many(words), many(eps)), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 200
    assert all(len(list(d.glob("part-*"))) == 1 for d in (tmp_path / "m").glob("bucket=*"))
