"""The queries of the operators and the pipeline over the smallest tables."""

import re

import duckdb
import pytest

import corpus_pipeline
from momentloom.llm import decontaminate, pii, queries
from momentloom.session import stage
from tools.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = db.execute(queries.ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_leaks_are_the_items_in_the_texts(spark):
    texts = {r.doc_id: " ".join(w.decode() for w in decontaminate.tokens(r.text or "")) for r in rows(spark, "documents")}
    items = {r.item_id: " ".join(w.decode() for w in decontaminate.tokens(r.text)) for r in rows(spark, "benchmark")}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in f" {t} "}
    assert want and {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_bm25_leaks"](spark, SF).collect()} == want


def test_near_duplicates_and_repeats_like_brute_force(spark):
    from tests.llm.test_neardup import brute
    from tests.llm.test_substring import brute as repeats
    import hashlib

    docs = [(r.doc_id, r.text) for r in rows(spark, "documents")]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op5_setsketch"](spark, SF).collect()} == brute(docs, 2)
    got = {tuple(r) for r in queries.QUERIES["op7_count_min_windows"](spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == {(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in repeats(docs)}


def test_article_texts(spark):
    import html

    want = {}
    for r in rows(spark, "pages"):
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in queries.QUERIES["op2_site_style_tree"](spark, SF).collect()} == want


def entities(text):
    """Pieces around the entities of a text and the entities, by the same patterns in Python."""
    import regex

    found = list(regex.compile(pii.ALL).finditer(text))
    cuts = [0, *(x for m in found for x in m.span()), len(text)]
    return [text[cuts[k]:cuts[k + 1]] for k in range(0, len(cuts), 2)], [m[0] for m in found]


def luhn(number):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(re.sub(r"\D", "", number))))) % 10 == 0


def test_private_strings_like_plain_python(spark):
    old = {r.doc_id: r.text for r in rows(spark, "documents")}
    new = {r.doc_id: (r.text, r.n_entities) for r in queries.QUERIES["op4_surrogates"](spark, SF).collect()}
    one_to_one, total = {}, 0
    for i, t in old.items():
        seps, found = entities(t or "")
        # A number shaped like a card that fails the check stays.
        stays = [bool(re.fullmatch(r"[2-6](?:[ \-]?\d){12,18}", e)) and not luhn(e) for e in found]
        pattern = re.escape(seps[0]) + "".join((re.escape(e) if s else "(.+?)") + re.escape(x) for e, s, x in zip(found, stays, seps[1:]))
        m = re.fullmatch(pattern, new[i][0] or "", re.S)
        changed = [e for e, s in zip(found, stays) if not s]
        assert m and new[i][1] == len(changed) == len(m.groups()), (i, t, new[i])
        total += len(changed)
        for e, x in zip(changed, m.groups()):
            assert e != x
            if not e[0].isalpha() or "@" in e:      # a word may be one person's given and another's family name
                plain = lambda v: re.sub(r"[ ().\-]", "", v).lower() if v[0] in "+(" or v.isdigit() else v.lower()
                assert one_to_one.setdefault(plain(e), plain(x)) == plain(x)
    assert total > 20 and len(set(one_to_one.values())) == len(one_to_one)


PRIVATE = r"[\w.]+@[\w.]+\w|\+1 \(\d+\) \d+-\d+|\b\d+\.\d+\.\d+\.\d+\b|\b[0-9a-fA-F]{40}\b|AKIA\w{16}|(?<=password=)\w+"


def test_pipeline_against_brute_force(spark):
    import struct

    import public_tokenizers
    import tiktoken

    from momentloom.llm.bpe import read_ranks
    from tests.llm.test_neardup import brute

    kept = {r.doc_id for r in queries.QUERIES["op10_quality_rules"](spark, SF).collect() if r.kept}
    docs = {r.doc_id: r.text for r in rows(spark, "documents")}
    groups = brute([(i, docs[i]) for i in sorted(kept)], 5)
    left = {i for i in kept if groups[i][1] == i}
    leaky = {r.doc_id for r in queries.QUERIES["op1_bm25_leaks"](spark, SF).collect()}
    left -= leaky
    out, read = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = out.columns
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, out, SF), f"test-{name}")
        read.append(out)
        assert name == "byte-bpe" or out.columns == columns
    assert {r.doc_id for r in read[0].collect()} == kept
    assert {r.doc_id for r in read[2].collect()} == left
    new = {r.doc_id: r for r in read[3].collect()}
    assert set(new) == left and all(r.n_chars == len(r.text) for r in new.values())
    assert not [m for i in left for m in re.findall(PRIVATE, docs[i]) if m in new[i].text]
    path = public_tokenizers.path(queries.RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    import base64
    for r in read[4].collect():
        ids = library.encode_ordinary(new[r.doc_id].text)
        assert r.intact and r.n_tokens == len(ids) and base64.b64decode(r.ids_base64) == struct.pack(f"<{len(ids)}I", *ids)
