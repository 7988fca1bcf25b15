import random

import numpy as np

from momentloom.llm import neardup as N
from momentloom.llm.graph import components


def brute(rows, width, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    sets = {i: shingles(t) for i, t in rows if i is not None}
    comp = {i: i for i in sets}
    ids = sorted(i for i in sets if sets[i])
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low = min(comp[a], comp[b])
                    old = {comp[a], comp[b]}
                    comp = {k: low if v in old else v for k, v in comp.items()}
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def variants(seed, n, words, edits):
    rand = random.Random(seed)
    base = [f"w{rand.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rand.randrange(edits)):
            w[rand.randrange(words)] = f"e{rand.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    texts = variants(1, 40, 60, 14) + variants(2, 30, 200, 30) + variants(3, 10, 8, 3)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "É one"), (7, "é one"), (8, texts[0].upper()), (9, "a " * 3000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    for width in (2, 5):
        want = brute(rows, width)
        got = N.near_duplicates(docs, width).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_rows_without_or_with_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "a b c d e f")], "doc_id long, text string")
    got = N.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [("7", 7, True)] * 2 + [("8", 7, False)] + [("None", None, True)] * 2
    assert N.drop_near_duplicates(docs).count() == 4
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_each_text_of_a_doc_id_links(spark):
    base = [" ".join(f"{x}{k}" for k in range(60)) for x in "pqr"]
    rows = [(7, base[0]), (7, base[1]), (8, base[0] + " more"), (9, base[1] + " more"), (10, base[2]), (11, base[2] + " x"), (6, "alone here"), (12, ""), (12, base[2])]
    want = {(7, 7), (8, 7), (9, 7), (10, 10), (11, 10), (6, 6), (12, 10)}
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles} == want and len(got) == len(rows)


def test_near_copies_have_few_hubs(spark):
    per_doc = []
    for n in (300, 1_500):
        rows = list(enumerate(variants(5, n, 120, 3)))
        sketches = N.sketch(spark.createDataFrame(rows, "doc_id long, text string"), 5)
        pairs = N._hub_pairs(N._bands(sketches.dropDuplicates(["fingerprint"])))
        per_doc.append(pairs.count() / n)
    assert per_doc[1] < 4 and per_doc[1] < 1.5 * per_doc[0], per_doc


def test_sketches_merge_and_estimate():
    rand = np.random.default_rng(1)
    pool = np.unique(rand.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = pool[:2000], pool[500:2400]
    ra, rb, both = N.registers([a, b, np.union1d(a, b)])
    assert (N.merge(ra, rb) == both).all()
    guess = N.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(guess - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.1
    assert (N.registers([np.zeros(0, dtype=np.uint64)]) == 0).all()


def test_components_of_stars_and_random_edges(spark):
    rand = random.Random(9)
    edges = [(0, i) for i in range(1, 400)] + [(rand.randrange(1000, 1600), rand.randrange(1000, 1600)) for _ in range(280)] + [(-5, -9), (2**61, -9)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500}
