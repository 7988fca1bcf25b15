import pytest
from pyspark.sql import functions as F

from momentloom.functions import text as T


def features(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [r.f for r in T.text_features(df, "text", "f").orderBy("id").collect()]


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_marker_features(spark):
    f = features(spark, "", "   \t ", "Hello world. How are you doing today? I'm fine!", "No wait, that's not right. Hold on.",
                 "Honestly, that was nuts. The truth is nobody talks about this.", "I'll be honest, I've never told anyone this story.",
                 "So anyway, speaking of which, the new policy moved on.", "In 2024 we did 50,000 reps and ran 3.5 miles.",
                 "Wow. That changes everything. I think it does in this particular case. Or does it?",
                 "Is this useful? Probably. Yes.", None)
    assert f[0] == f[1] == f[10] and f[0].total_words == 0 and f[0].quotable_lines == [] and f[0].avg_sentence_words == 0
    assert (f[2].sentence_count, f[2].total_words, f[2].questions, f[2].avg_sentence_words) == (3, 9, 1, 3.0)
    assert f[3].conflict_markers == 3
    assert f[4].strong_claim == 3
    assert f[5].confessional == 2
    assert f[6].topic_shift == 2
    assert f[7].numbers == 3
    assert f[8].quotable_lines == ["Wow", "That changes everything"] and f[8].short_declaratives >= 3
    assert all("?" not in q for q in f[9].quotable_lines)


def test_markers_ignore_case_and_respect_words(spark):
    f = features(spark, "HONESTLY dishonestly honestly!", "actually no, actually")
    assert f[0].strong_claim == 2 and f[1].conflict_markers == 1


def test_lexicon_is_a_parameter(spark):
    df = spark.createDataFrame([("aha aha oho",)], "text string")
    c = T.marker_counts("text", {"x": ["aha"], "y": ["ähm", "oho"]})
    assert df.select(*[v.alias(k) for k, v in c.items()]).first() == (2, 1)


@pytest.mark.parametrize("text,want", [("plain accents éà Ελ Привет", False), ("สวัสดี", True), ("한글", True), ("漢字", True), ("か", True), ("", False)])
def test_foreign_script(spark, text, want):
    assert value(spark, T.has_foreign_script(F.lit(text))) is want


@pytest.mark.parametrize("text,want", [("a b c d e", 0), ("a b c a b c", 2), ("Thank you very much. " * 5, 5), ("", 0)])
def test_trigram_repeat(spark, text, want):
    assert value(spark, T.trigram_repeat(F.lit(text))) == want


@pytest.mark.parametrize("name,want", [("Hot Boxin' with Mike Tyson", "hot_boxin_with_mike_tyson"),
                                       ("TFATK #1147 — Nick Simmons", "tfatk_1147_nick_simmons"), ("!!!", ""), ("Éa", "a")])
def test_slugify(spark, name, want):
    assert value(spark, T.slugify(F.lit(name))) == want


def test_time_formats(spark):
    assert value(spark, T.fmt_mmss(F.lit(3725.9))) == "62:05"
    assert value(spark, T.fmt_hms(F.lit(3725.9))) == "1h 02m 05s"
    assert value(spark, T.fmt_hms(F.lit(65.0))) == "1m 05s"
    assert value(spark, T.fmt_duration(F.lit(-3))) == "0m 0s"
    assert value(spark, T.fmt_iso(F.lit(0))) == "1970-01-01T00:00:00+00:00"


def test_fixed_rounds_the_binary_value_half_even(spark):
    for x in (64.05, 0.125, 2.5, 3.45, 1234.5, -0.05, 0.05, 0.005):
        for d in (0, 1, 2):
            got = value(spark, T.fixed(F.lit(x), d))
            assert got.replace("-0.0", "0.0") in (f"{x:.{d}f}", f"{x:.{d}f}".replace("-0.0", "0.0")), (x, d)


def test_hooks(spark):
    assert value(spark, T.clean_hook(F.lit("  one two  three four five six "))) == "one two three four five"
    assert value(spark, T.clean_hook(F.lit("The end..."))) == "The end"
    r = lambda w, k, m, i: tuple(value(spark, T.resolve_hook(F.lit(w), F.lit(k), F.lit(m), F.lit(i))))
    assert r("My hook.", "Other", "llm", 0) == ("My hook", "llm")
    assert r(" ", "Other one.", "llm", 0) == ("Other one", "fallback")
    assert r("My hook.", "Other", "ranker", 0) == ("Other", "ranker")
    assert r("My hook.", "Other", "ab_test", 2) == ("My hook", "llm")
    assert r("My hook.", "Other", "ab_test", 3) == ("Other", "ranker")
    assert value(spark, T.hook_mode(F.lit(" AB "))) == "ab_test"


@pytest.mark.parametrize("a,b,w,want", [(80, 40, .5, 60), (80, 40, 0, 80), (80, 40, 1, 40), (72, 90, .6, 83), (101, 200, .5, 100), (1, 2, .5, 2)])
def test_blend(spark, a, b, w, want):
    assert value(spark, T.blend(F.lit(a), F.lit(b), float(w))) == want


def test_clamps_count_characters(spark):
    assert value(spark, T.clamp_chars(F.lit("äöüß"), 3)) == "äöü"
    assert value(spark, T.clamp_chars(F.lit("abcdefgh"), 6, "dots")) == "abc..."
    assert value(spark, T.clamp_chars(F.lit("abcdefgh"), 4, "ellipsis")) == "abc…"
    assert value(spark, T.clamp_chars(F.lit("abc"), 3, "dots")) == "abc"


def test_targets(spark):
    assert value(spark, T.parse_platforms(F.lit("yt, shorts ,BSKY,what,,ig"))) == ["youtube", "bluesky", "instagram"]
    assert value(spark, T.parse_formats(F.lit("vertical,9x16, Square ,square,??"))) == ["9x16", "9x16", "1x1"]
    acc = value(spark, T.parse_accounts(F.lit("x:main, twitter:alt,li:a:b,bad,nope:z"), F.lit("")))
    assert [tuple(a) for a in acc] == [("x", "main", True), ("x", "alt", False), ("linkedin", "a:b", True)]
    acc = value(spark, T.parse_accounts(F.lit("twitter:alt,x:main"), F.lit("x:main")))
    assert [tuple(a) for a in acc] == [("x", "alt", False), ("x", "main", True)]


def test_media_names(spark):
    assert value(spark, T.is_video(F.lit("A.MP4"))) and not value(spark, T.is_video(F.lit("a.mp3")))
    assert value(spark, T.url_filename(F.lit("https://h/a/b.mp4?x=/y"))) == "b.mp4"
    assert value(spark, T.url_filename(F.lit("https://h/a/"))) is None
    assert value(spark, T.object_key(F.lit("/w/clipper/ep/a/clipper/b.mp4"), "p")) == "p/ep/a"
    assert value(spark, T.object_key(F.lit("/other/x"))) == "other/x"


def test_trim_is_unicode(spark):
    assert value(spark, T.trim_ws(F.lit(" \t x y \n"))) == "x y"
