import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from momentloom.llm import line_bitmaps as L

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, pos int, word int, keep string"


def brute(docs):
    held = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                held[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < 3 or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], SCHEMA)
    out = L.apply_bitmaps(df, L.keep_bitmaps(df, **kw))
    return sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()), key=repr)


BANNER, OTHER = "Subscribe to our newsletter now", "ÄÖÜ is not folded but ABC is here"
DOCS = ([(i, f"{' ' * (i % 3)}{BANNER.upper() if i % 2 else BANNER}\t\nbody of document number {i}\nshort\n{OTHER}\n" + "x\n" * (i % 4)) for i in range(40)]
        + [(40, None), (41, ""), (42, "\n\n"), (43, f"{BANNER}\n{BANNER}\r\n{BANNER}"), (None, BANNER), (None, None), (50, OTHER.lower()),
           (60, f"{BANNER}\nlast of all"), (60, f"{BANNER}\nsecond row of 60"), (60, f"{BANNER}\nsecond row of 60"), (5, "exactly twenty chars"), (6, "exactly twenty chars"),
           (7, "exactly twenty chars"), (8, "only nineteen chars"), (9, "only nineteen chars"), (10, "only nineteen chars")])


@pytest.mark.parametrize("hot_rows", [1, 10, 100_000])
def test_like_brute_force(spark, hot_rows):
    assert run(spark, DOCS, hot_rows=hot_rows) == brute(DOCS)


def test_long_documents_and_word_borders(spark):
    lines = [f"line that is the same in all, number {i}" for i in range(1_000)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(lines[::2])), (3, "\n".join(["own"] * 63 + lines[60:70] + ["own"] * 200 + lines[-1:])),
            (4, "\n".join(lines[:128])), (5, "y" * 300_000 + "\n" + lines[7]), (-3, lines[7])]
    assert run(spark, docs) == brute(docs)


def test_bitmaps_are_sparse_and_only_for_documents_that_lose_lines(spark):
    docs = [(i, BANNER + "\n" + "own line\n" * 500 + BANNER) for i in range(3)]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], SCHEMA)
    found = {r.doc_id: [(w.word, w.bits) for w in r.keep] for r in L.keep_bitmaps(df).collect()}
    assert set(found) == {0, 1} and [w for w, _ in found[0]] == [0, 501 // 64] and found[0][0] == (0, -2)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_hot_keys_are_few_and_exact(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id")).alias("h1"), F.when(F.col("id") % 3 == 0, 8).otherwise(F.col("id")).alias("h2"), F.col("id").alias("doc_id"))
    assert [tuple(r) for r in L.hot_keys(rows, 100).collect()] == [(7, 8, 1_667, 4_998)]


def test_windows_use_the_range_partitions(spark):
    lines = spark.range(100).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), F.col("id").alias("doc_id"), F.lit(1).cast("bigint").alias("t1"),
                                    F.lit(1).cast("bigint").alias("t2"), F.lit(0).alias("pos"))
    plan = L.dropped_lines(lines)._jdf.queryExecution().executedPlan().toString()
    windows = plan[plan.index("Window"):]
    assert "rangepartitioning(h1" in windows and "hashpartitioning(h1" not in windows.replace("hot-lines", "")
