from math import comb

from pyspark.sql import functions as F

from momentloom.llm import quality


def test_features(spark):
    text = "a b c a b c\n\na b c\n \na b c\n" + "x#$ <>"
    rows = [(1, text), (2, None), (3, ""), (4, " \t\n"), (5, "one two three four"), (6, "w " * 3), (6, "w " * 4)]
    docs = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, severity double")
    got = [tuple(r) for r in quality.with_features(docs).select("doc_id", *quality.FEATURES[:5]).collect()]
    assert got[0] == (1, 14, 17, 4, 1, 12)
    assert got[1:5] == [(2, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0), (4, 0, 0, 0, 0, 0), (5, 4, 15, 0, 0, 0)]
    assert [g[5] for g in got[5:]] == [0, 4]


def test_repeated_words_against_brute_force(spark):
    import random
    rand = random.Random(3)
    rows = [(i, " ".join(rand.choice("abcd") for _ in range(rand.randrange(60)))) for i in range(60)]
    got = {r.doc_id: r.n_repeat_words for r in quality.with_features(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = t.split()
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        hit = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
        assert got[i] == len(hit)


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 200), (7, 400), (8, 400), (30, 2000)]
    got = spark.createDataFrame(cases, "k long, n long").select(quality._tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for (k, n), r in zip(cases, got):
        want = sum(comb(n, i) * 0.02**i * 0.98**(n - i) for i in range(k + 1)) if k < n * 0.02 else 1.0
        assert abs(r.p - want) < 1e-9


def corpus(spark, clean=400, lang="en"):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(i, good + f" {i}", lang) for i in range(clean)] + [(clean + i, good.replace(" ", "### ") + f" {i}", lang) for i in range(40)]
    labels = [(i, int(i < clean), 0) for i in range(clean + 40)] + [(None, 1, 0), (3, None, 0), (10**9, 0, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_junk_goes_and_clean_documents_stay(spark):
    docs, labels = corpus(spark)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == set(range(400))
    cutoffs = quality.certify(quality.with_features(docs), labels).collect()
    assert [(r.stratum, r.n_clean, r.n_rejected) for r in cutoffs] == [("en", 400, 0)]


def test_too_few_labels_certify_nothing(spark):
    docs, labels = corpus(spark, clean=60, lang=None)
    assert quality.certify(quality.with_features(docs), labels).count() == 0
    assert quality.keep_good(docs, labels).count() == 100
    empty = spark.createDataFrame([], labels.schema)
    assert quality.keep_good(docs, empty).count() == 100 and quality.keep_good(docs.limit(0), labels).count() == 0


def test_any_number_of_strata(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 1_500).cast("string")).alias("lang"), F.repeat(F.concat(F.col("id").cast("string"), F.lit("x# ")), F.lit(60)).alias("text"))
    cutoffs = spark.range(1_500).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("stratum"), F.when(F.col("id") % 2 == 0, 0.25).otherwise(1e9).alias("cutoff"))
    rows = quality.with_verdict(quality.with_features(docs).withColumn("n_repeat_words", F.lit(0)), cutoffs)
    got = {r.doc_id: r.kept for r in rows.select("doc_id", "kept").collect()}
    assert got == {i: i % 2 == 1 for i in range(3_000)}


def test_plan_is_native(spark):
    docs, labels = corpus(spark, clean=60)
    plan = quality.keep_good(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
