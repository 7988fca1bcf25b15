import gzip
import hashlib
import re
from pathlib import Path

from momentloom.llm import warc


def test_url_keys():
    assert warc.url_key("HTTPS://Www.Example.org:8080/a b?q=1#x") == "org,example,www:8080)/a%20b?q=1"
    assert warc.url_key(None) == ")" and warc.url_key("http://[bad") == ")http://[bad"


def test_round_trip_through_the_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    big = "<p>é\r\n\r\n</p>" * 40
    rows = [(i, f"http://h{i % 3}.example.com/p{i}", f"<b>{i}</b>" * 30) for i in range(20)]
    rows += [(50, "http://same.org/", big), (40, "http://same.org/", big), (41, "http://same.org/", big), (41, "http://same.org/", big),
             (60, None, None), (61, "", ""), (62, "http://x.org/", "short"), (63, "http://x.org/", "short"), (None, "http://n.org", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string")
    directory, archives, index = warc.archive_pages(pages)
    assert directory.count() > 3
    out = warc.read_records(warc.lookup(pages.select(warc.key_of(pages.url).alias("key")), directory, index), archives, payload=True).collect()
    assert len(out) == len(rows)
    bodies = {r[0]: (r[2] or "").encode() for r in rows}
    for r in out:
        body = bodies[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 40) if body == big.encode() and r.page_id != 40 else ("response", None))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body
    assert {r.url for r in out} == {r[1] for r in rows}
    missing = spark.createDataFrame([("org,nowhere)/",), (None,)], "key string")
    assert {r.page_id for r in warc.lookup(missing, directory, index).collect()} == {60, 61}
    ids = []
    for file in Path(archives.removeprefix("file://")).glob("*.warc.gz"):
        whole = gzip.decompress(file.read_bytes())
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        heads = whole.split(b"WARC/1.1\r\n")[1:]
        ids += [re.search(rb"WARC-Record-ID: (<urn:uuid:[0-9a-f-]{36}>)\r\n", h)[1] for h in heads]
        assert all(b"WARC-Target-URI: http" in h for h in heads if b"X-Page-ID: 5\r\n" in h) and b"X-Page-ID: 60\r\nWARC-Target" not in whole
    assert len(ids) == len(set(ids)) > len(rows)


def test_addresses_in_headers():
    for url in ("http://a.org/x y", "http://ä.org/ü?q=\r\nX: 1", "http://a.org/%20", "", None, " "):
        record = warc._record("response", None, url, b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None)
        head = record.split(b"\r\n\r\n")[0].decode("ascii")
        got = warc._parse(warc._gzip(record))
        assert got["url"] == url and got["page_id"] is None and ("\nX: 1" not in head)
    assert warc.target_uri("http://a.org/x y?é") == "http://a.org/x%20y?%C3%A9"


def test_block_after_a_crowded_key_of_another_file(spark, tmp_path):
    spans, at = [], {"a.cdx": 0, "b.cdx": 0}
    for file, keys in (("b.cdx", "kk"), ("b.cdx", "kk"), ("a.cdx", "kmz"), ("a.cdx", "zz")):
        block = warc._gzip("\n".join(f"{k} {len(spans)} f {i} 1" for i, k in enumerate(keys)).encode())
        with (tmp_path / file).open("ab") as f:
            f.write(block)
        spans.append((keys[0], keys[-1], file, at[file], len(block)))
        at[file] += len(block)
    directory = spark.createDataFrame(spans, "first_key string, last_key string, file string, offset long, length long")
    for fanout in (1, 1024):
        found = warc.lookup(spark.createDataFrame([(k,) for k in "akmz"], "key string"), directory, f"file://{tmp_path}", fanout).collect()
        assert sorted((r.key, r.page_id) for r in found) == [("k", 0), ("k", 0), ("k", 1), ("k", 1), ("k", 2), ("m", 2), ("z", 2), ("z", 3), ("z", 3)]


def test_crowded_key_over_several_index_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(i, None, "x") for i in range(300)] + [(1000 + i, f"http://z.org/{i % 90:02d}", "x") for i in range(180)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        directory, archives, index = warc.archive_pages(pages)
        assert directory.filter("first_key = ')'").select("file").distinct().count() > 3
        found = warc.lookup(pages.select(warc.key_of(pages.url).alias("key")), directory, index)
        assert sorted(r.page_id for r in found.collect()) == [r[0] for r in rows]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    directory, archives, index = warc.archive_pages(pages)
    found = warc.lookup(spark.createDataFrame([("a)/",)], "key string"), directory, index)
    assert directory.count() == 0 and warc.read_records(found, archives).count() == 0
