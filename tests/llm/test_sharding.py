import zlib

import numpy as np

from momentloom.llm import sharding as S


def plain_jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_against_the_published_loop_and_growth():
    keys = np.array([0, 1, 2, 7, 2**40 + 3, 2**63, 2**64 - 1] + list(range(500)), dtype=np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert S.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    old, new = S.jump(keys, 8), S.jump(keys, 9)
    assert all(a == b or b == 8 for a, b in zip(old, new))


def test_assign_shards_rows(spark):
    rows = [(i, f"text {i}", 1) for i in range(300)] + [(5, "text 5", 2), (5, "other", 2), (None, "x", 3), (-4, None, 4), (9, "é" * 10, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = S.assign_shards(docs, 8, grown=9).collect()
    assert len(out) == len(rows)
    for k in range(8):
        slots = sorted(r.slot for r in out if r.shard == k)
        assert slots == list(range(len(slots)))
    for r in out:
        assert r.shard == plain_jump(r.doc_id or 0, 8) and r.grown_shard in (r.shard, 8) and r.law == "key"
    assert {(r.size, r.text_crc32) for r in out if r.doc_id == -4} == {(1, 0)}
    assert (21, zlib.crc32(("é" * 10).encode())) in {(r["size"], r.text_crc32) for r in out if r.doc_id == 9}
    assert all(r.grown_shard is None for r in S.assign_shards(docs, 3).collect())


def test_empty_table(spark):
    assert S.assign_shards(spark.createDataFrame([], "doc_id long, text string"), 8).count() == 0


def test_written_shards_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    S.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.doc_id, r.shard) for r in back} == {(i, plain_jump(i, 4)) for i in range(50)}
