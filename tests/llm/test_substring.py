import random

from momentloom.llm import substring as S


def brute(rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            key = tuple(w[k:k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k:k + 50])] < i:
                gone.update(range(k, k + 50))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def made():
    rand = random.Random(5)
    word = lambda n: [f"w{rand.randrange(10**9)}" for _ in range(n)]
    shared, other = word(70), word(49)
    rows = [(i, " ".join(word(30) + shared[i % 3:] + word(20))) for i in range(40, 20, -1)]
    rows += [(50 + i, " ".join(word(5) + other + word(5))) for i in range(5)]
    rows += [(70, "x " * 500), (71, "x " * 120), (72, " ".join(shared + shared)), (73, None), (74, ""), (75, " \n"), (76, " ".join(word(3000)))]
    rows += [(80 + i, rows[0][1]) for i in range(30)] + [(90, rows[-1][1]), (None, rows[0][1]), (None, "y " * 60)]
    rows += [(77, "É é " * 30), (78, "é É " * 30)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_DOCS", 7)
    rows = made()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, chunk int")
    got = [tuple(r) for r in S.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "text").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_hot_and_missing_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_DOCS", 20)
    rows = made() + [(30, f"{k} " + " ".join(f"r{j % 77}" for j in range(k, k + 60))) for k in range(100)]
    rows += [(None, f"a{k}\x0b\x1cb\u00a0c \r\n d") for k in range(100)] + [(29, " ".join(f"r{j % 77}" for j in range(90)))]
    seen, group = [], type(spark.range(0)).groupBy
    monkeypatch.setattr(type(spark.range(0)), "groupBy", lambda df, *c: (seen.append(df) if c == ("chunk",) and "text" in df.columns else None, group(df, *c))[1])
    got = [tuple(r) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "text").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    dealt = [(r.chunk, r.doc_id) for r in seen[0].collect()]
    most = max(dealt.count((c, 30)) for c, _ in dealt)
    assert None not in {d for _, d in dealt} and most < 50


def test_chunks_are_bounded_by_bytes_too():
    assert (S._chunks(0, 0), S._chunks(801, 5), S._chunks(3, 100 * S.CHUNK_BYTES)) == (1, 2, 100)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_DOCS", 10)
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(S, "SHARD_WINDOWS", 1000)  # the cells stay as many, the shards grow
    got = [tuple(r) for r in S.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "text").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
