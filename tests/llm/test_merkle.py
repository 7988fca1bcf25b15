import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from momentloom.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, tree int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Root and, for each leaf, its siblings as (digest or None, is left)."""
    paths, at, own = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(at) > 1:
        for i, k in enumerate(own):
            other = k ^ 1
            paths[i].append((at[other] if other < len(at) else None, other < k))
        at = [h(*at[k:k + 2]) for k in range(0, len(at), 2)]
        own = [k // 2 for k in own]
    return at[0], paths


def fold(digest, path):
    for other, left in path:
        digest = h(digest) if other is None else h(other, digest) if left else h(digest, other)
    return digest


def brute(docs):
    by = {}
    for r in docs:
        by.setdefault(r[2], []).append((r, leaf(r[0], r[3], r[2], r[4], r[1])))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    out, trees = [], []
    for lang in langs:
        rows = sorted(by[lang], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((rows, *tree([d for _, d in rows])))
    root, tops = tree([t[1] for t in trees]) if trees else ("", [])
    for (rows, subroot, paths), top in zip(trees, tops):
        for (r, digest), path in zip(rows, paths):
            path = path + top
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            folded = fold(leaf(r[0], r[3], r[2], r[4] + 1, r[1]) if changed else digest, path)
            out.append((r[0], digest, subroot, root, h(*[s for s, _ in path if s]), folded, folded == root))
    return sorted(out, key=repr)


def run(spark, docs, tmp_path):
    rows = [(i, t, lang, s, n, "x", 1) for i, t, lang, s, n in docs]
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.QUERIES["op13_merkle_proofs"](spark, str(tmp_path)).collect()), key=repr)


ODD = [(None, None, None, None, None), (None, "a", None, "s", 1), (1, "ä" * 3, "en", "s", 3), (1, "ä" * 3, "en", "s", 3), (1, "b", "en", None, None), (-5, "", "en", "", 0),
       (2**62, "x" * 200_000, "", "s", 2**63 - 1), (7, "1:2", "ß", "s", 1), (8, None, "z", "s", None)]


@pytest.mark.parametrize("docs", [ODD, ODD[:1], ODD[2:4], [], ODD[6:]])
def test_like_plain_python(spark, tmp_path, docs):
    assert run(spark, docs, tmp_path) == brute(docs)


def test_deep_trees(spark, tmp_path):
    docs = [(3 * i - 700, f"text {i}", ["en", "en", "en", None, "fr"][i % 5] if i < 1_200 else "en", "s", i) for i in range(2_000)]
    docs += [(9_999, "same", "xx", "s", 4)] * 300
    got = run(spark, docs, tmp_path)
    assert got == brute(docs)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


def test_numbers_follow_the_order_without_a_window_over_the_group(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1_000)).alias("v"))
    got = merkle.numbered(rows.repartition(7), "g", ["v"]).collect()
    for g in "ab":
        mine = sorted((r.idx, r.v) for r in got if r.g == g)
        assert [i for i, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
        assert {r.n for r in got if r.g == g} == {len(mine)}
