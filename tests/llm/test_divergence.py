import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from momentloom.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, lang string, source string, text string, value long, rank int"


def brute(docs, least=10, top=10):
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(FOLD))
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        of = {s: counts[lang, s] for x, s in groups if x == lang}
        every = sum(of.values(), Counter())
        total = {s: sum(c[t] for t in kept) for s, c in of.items()}

        def share(c, n):
            return 1 + 10**9 * (c + 2) // (n + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        pairs = [(s, sum(f(share(of[source][t], total[source]), share(of[s][t], total[s])) for t in kept)) for s in of if s != source]
        terms = [(t, f(p, q)) for t in kept if of[source][t] and (p := share(of[source][t], total[source])) > (q := share(every[t], sum(total.values())))]
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1):
                if part == "pair" or rank <= top:
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


def audit(spark, docs, **kw):
    rows = [(i, lang, source, text, 7, 3) for i, (lang, source, text) in enumerate(docs)]
    return sorted(tuple(r) for r in D.audit(spark.createDataFrame(rows, SCHEMA), **kw).collect())


DOCS = ([("en", f"s{i % 5}", f"The cat{'s' * (i % 7)} sat; ON the-mat{i} naïve 東京都 {'ab' * (i % 9)}x") for i in range(60)]
        + [(None, None, None), (None, "s1", ""), (None, "s2", "..."), ("de", "lone", "größe " * 40), ("", "s1", "a"), ("en", "bare", "123 !?"), ("en", "none", None)]
        + [("en", "s1", "same text here")] * 4)


def test_like_brute_force(spark):
    for least in (2, 10):
        assert audit(spark, DOCS, least_docs=least) == brute(DOCS, least)


def test_long_terms_and_texts(spark):
    words = ["é" * k for k in (1, 4, 5, 8, 9, 16, 17, 33, 5_000)] + ["x" * 70_000, "Z" * 16, "z" * 16, "Z" * 17]
    docs = [("xx", f"s{i % 2}", " ".join(words[i % 3:] * (1 + i % 4))) for i in range(12)] + [("xx", "s2", "word " * 400_000)]
    assert audit(spark, docs, least_docs=2) == brute(docs, 2)


def test_empty_table_and_no_kept_term(spark):
    assert audit(spark, []) == []
    docs = [("en", "a", "one"), ("en", "b", "two"), ("en", "c", None)]
    assert audit(spark, docs) == brute(docs) and all(r[4] == 0 for r in audit(spark, docs))


def test_many_sources_and_small_parts(spark, monkeypatch):
    docs = [("en", f"s{i % 37}", f"w{chr(97 + i % 5)} q{chr(97 + i % 11)}ab common") for i in range(400)]
    monkeypatch.setattr(D, "SOURCE_BLOCK", 10)
    monkeypatch.setattr(D, "CELLS", 100)
    monkeypatch.setattr(D, "SLICE_BYTES", 300)
    assert audit(spark, docs) == brute(docs)


@pytest.mark.parametrize("gathered", [5, 100_000])
def test_runs_are_handed_on_and_merged(gathered, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "GATHERED", gathered)
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 3, n)) for n in rng.integers(1, 24, 50)) for _ in range(40)]
    source = [f"s{i % 3}" for i in range(40)]
    counter = D.Counter(4)
    out = []
    for a in range(0, 40, 10):
        out += list(counter.add(["en"] * 10, source[a:a + 10], pa.array([t.encode() for t in texts[a:a + 10]], pa.large_binary())))
    out += list(counter.flush())
    assert len(out) > 1 or gathered > 5
    got = Counter()
    docs = Counter()
    rows = [r for b in out for r in b.to_pylist()]
    by = defaultdict(list)
    for r in rows:
        by[r["kind"], r["shard"]].append(r)
    for group in by.values():
        for b in D._merge_shard(1)(iter([pa.RecordBatch.from_pylist(group, schema=D._PACKED_ARROW)])):
            for r in b.to_pylist():
                assert r["term"] not in docs
                docs[r["term"]] = r["docs"]
                got.update({(r["term"], s): n for s, n in zip(r["sources"], r["counts"])})
    assert got == Counter((w.encode(), s) for t, s in zip(texts, source) for w in t.split())
    assert docs == Counter(w.encode() for t in texts for w in set(t.split()))


@pytest.mark.parametrize("gathered", [5, 200])
def test_runs_handed_on_between_the_slices_of_a_batch(gathered, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "GATHERED", gathered)
    monkeypatch.setattr(D, "SLICE_BYTES", 100)
    texts = [" ".join(chr(97 + (i * k) % 26) * (1 + k % 20) for k in range(30)) for i in range(40)]
    lang, source = [f"l{i % 2}" for i in range(40)], [f"s{i % 7}" for i in range(40)]
    counter, out = D.Counter(2), []
    for a in (20, 0):
        out += list(counter.add(lang[a:a + 20], source[a:a + 20], pa.array([t.encode() for t in texts[a:a + 20]], pa.large_binary())))
    assert len(out) > 1
    out += list(counter.flush())
    got = Counter()
    for r in (r for b in out for r in b.to_pylist()):
        terms = D._term_bytes(D._unpack_terms(r["kind"], r["terms"])).to_pylist()
        for term, s, n in zip(terms, D._unpack(r["source"]).tolist(), D._unpack(r["n"]).tolist()):
            got[r["lang"], r["sources"][s], term] += n
    assert got == Counter((x, s, w.encode()) for x, s, t in zip(lang, source, texts) for w in t.split())


def test_shares_are_exact():
    n = np.array([[5 * 10**12 - 3, 0, 10**13 - 4]])
    total = np.array([[10**13, 10**13, 10**13 - 4]])
    assert D._share(n, total, 1).tolist() == [[1 + 10**9 * (int(c) + 2) // (int(t) + 2) for c, t in zip(n[0], total[0])]]
