"""Queries over the given tables, one per operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.llm import bpe, chat, decontaminate, divergence, html_extract, line_bitmaps, merkle, neardup, pii, quality, sharding, substring, warc
from momentloom.llm.common import only, table
from momentloom.session import stage

#: Key of the surrogates in these queries; a real run passes its own, kept secret.
SECRET = "corpus"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


_WORDS = "list_filter(regexp_extract_all({t}, '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_bm25_leaks")
def op1(spark, sf_dir):
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") > 0).select("doc_id", F.inline("leaks"))


@query("op2_site_style_tree")
def op2(spark, sf_dir):
    texts = html_extract.extract_text(only(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


_FOLD = "xor(xor(xor(xor(doc_id, doc_id >> 12), doc_id >> 24), doc_id >> 36), doc_id >> 48) & 4095"
OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, coalesce(doc_id, 0) AS doc_id, coalesce(text, '') AS text FROM documents),
jump AS (
  SELECT r, n, CASE WHEN doc_id < 0 THEN doc_id + 18446744073709551616::HUGEINT ELSE doc_id::HUGEINT END AS k,
         -1::BIGINT AS b, 0::BIGINT AS j
  FROM d, (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT r, n, k2, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT r, n, j, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM jump WHERE j < n)),
place AS (SELECT r, max(b) FILTER (n = 8) AS shard, max(b) FILTER (n = 9) AS grown FROM jump WHERE j >= n GROUP BY r),
crc AS (
  SELECT r, doc_id, octet_length(encode(text)) + 1 AS size,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
             range(octet_length(encode(text))),
             lambda i: [('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384))) AS text_crc32
  FROM d)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY {_FOLD}, doc_id, text_crc32, size) - 1 AS slot, grown::INT AS grown_shard
FROM crc JOIN place USING (r)
"""


@query("op3_jump_shards", OP3_SQL)
def op3(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 8, grown=9)


@query("op4_surrogates")
def op4(spark, sf_dir):
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pii.pseudonymize(docs, key=SECRET)


OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, b AS o FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.o),
m AS (SELECT id, min(o) AS o FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(o, w.doc_id)) AS component_id, w.doc_id <= coalesce(o, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id
"""


@query("op5_setsketch", OP5_SQL)
def op5(spark, sf_dir):
    return neardup.near_duplicates(only(table(spark, sf_dir, "documents"), "doc_id", "text"), width=2, percent=80)


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query("op6_warc_index", OP6_SQL)
def op6(spark, sf_dir):
    pages = only(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    directory, archives, index = warc.archive_pages(pages)
    keys = pages.select(warc.key_of(F.col("url")).alias("key"))
    records = warc.read_records(warc.lookup(keys, directory, index), archives)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS i)),
first AS (SELECT g, min(doc_id) AS f FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN first USING (g), range(50) t(k) WHERE f < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT x.doc_id, count(gone.p) AS n, string_agg(word, ' ' ORDER BY x.p) FILTER (gone.p IS NULL) AS kept
      FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


@query("op7_count_min_windows", OP7_SQL)
def op7(spark, sf_dir):
    kept = substring.remove_repeats(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Rank file of the query; a run elsewhere may name another.
RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op8_byte_bpe")
def op8(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(ids, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_CASE = "\\### Assistant: </turn> ok"
OP9_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CASE}' UNION ALL SELECT -7, 1, 'assistant', '{_CASE}'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss FROM t GROUP BY 1),
e AS (
  SELECT conv_id, turn, role, text, lag(role) OVER w AS before,
         regexp_replace(text, '(\\\\|#)', '\\\\\\1', 'g') AS esc,
         regexp_replace(role, '(\\\\|#|:)', '\\\\\\1', 'g') AS erole
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (
  SELECT conv_id, string_agg(CASE WHEN before IS NULL THEN '### ' || erole || ': ' WHEN before = role THEN '</part>'
                                  ELSE '</turn>' || chr(10) || '### ' || erole || ': ' END || replace(esc, '</', '<\\/'), '' ORDER BY turn, role, text)
         || '</turn>' || chr(10) AS formatted FROM e GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, length(formatted) AS formatted_chars
FROM g JOIN f USING (conv_id)
"""


@query("op9_chat_format", OP9_SQL)
def op9(spark, sf_dir):
    added = spark.createDataFrame([(-7, 0, "user", _CASE), (-7, 1, "assistant", _CASE)], "conv_id long, turn long, role string, text string")
    turns = only(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(added)
    out = chat.format_conversations(turns)
    read = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("segments")).alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(list_filter(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w,
             generate_subscripts(list_filter(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), lambda x: x <> ''), 1) AS i FROM d),
g AS (SELECT r, i, w, lead(w) OVER o || ' ' || lead(w, 2) OVER o AS more FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, w, count(*) OVER (PARTITION BY r, w, more) > 1 AND more IS NOT NULL AS twice FROM g),
f AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars,
             count(*) FILTER (hit) AS n_repeat_words
      FROM (SELECT *, twice OR coalesce(lag(twice) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit FROM c
            WINDOW o AS (PARTITION BY r ORDER BY i)) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
s AS (SELECT d.doc_id, stratum, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS upper, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters
      FROM d LEFT JOIN f USING (r) LEFT JOIN l USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             greatest(coalesce(n_symbols / nullif(n_words, 0), 0) / {quality.SYMBOLS_PER_WORD}::DOUBLE,
                      coalesce(n_repeat_words / nullif(n_words, 0), 0) / {quality.REPEATED_WORDS}::DOUBLE,
                      coalesce(n_dup_lines / nullif(n_lines, 0), 0) / {quality.DUPLICATE_LINES}::DOUBLE,
                      coalesce(upper / nullif(letters, 0), 0) / {quality.CAPITALS_PER_LETTER}::DOUBLE,
                      coalesce(word_chars / nullif(n_words, 0), 0) / {quality.LETTERS_PER_WORD}::DOUBLE) AS severity FROM s),
m AS (SELECT stratum, severity, clean FROM v JOIN (SELECT doc_id, min(quality) = 1 AS clean FROM labels
      WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1) USING (doc_id)),
k AS (SELECT stratum, j, count(*) FILTER (clean) AS n, count(*) FILTER (clean AND severity * 4 > j) AS k,
             count(*) FILTER (NOT clean AND severity * 4 > j) AS caught
      FROM m, range(1, {quality.STEPS} + 1) t(j) GROUP BY ALL),
q AS (SELECT *, CASE WHEN k < n * 0.02 THEN list_sum(list_transform(range(k + 1), lambda i:
               exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98)))) ELSE 1 END AS tail,
             (SELECT count(DISTINCT stratum) FROM m) AS strata FROM k WHERE n > 0),
b AS (SELECT stratum, arg_max(j, (caught - k) * 100 + j) / 4.0 AS cutoff FROM q WHERE tail * strata <= 0.05 AND caught > k GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(severity > cutoff, false) AS kept
FROM v LEFT JOIN b USING (stratum)
"""


@query("op10_quality_rules", OP10_SQL)
def op10(spark, sf_dir):
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "lang", "text")
    rows = stage(quality.with_features(docs).drop("text"), "quality")
    cutoffs = quality.certify(rows, table(spark, sf_dir, "labels"))
    return quality.with_verdict(rows, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                      quality.base_failed().alias("base_failed"), "kept")


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS lc FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
l AS (SELECT lang, sum(lc) AS ln, count(*)::HUGEINT AS v FROM k GROUP BY 1),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
             1 + 1000000000 * (coalesce(c, 0) + 2) // (coalesce(n, 0) + 2 * v) AS p, 1 + 1000000000 * (lc + 2) // (ln + 2 * v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM x QUALIFY part = 'pair' OR rank <= 10
"""


@query("op11_source_divergence", OP11_SQL)
def op11(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


_TRIM = "trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate({_TRIM.format(x="line")}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
b AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(doc_id < keeper, false) AS gone FROM k LEFT JOIN b USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


@query("op12_line_bitmaps", OP12_SQL)
def op12(spark, sf_dir):
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    left = line_bitmaps.apply_bitmaps(docs, line_bitmaps.keep_bitmaps(docs))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"


def _crc32_sql(text: str) -> str:
    return (f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length({text})), "
            f"lambda i: [ascii(substr({text}, i + 1, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)))")


OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, {_LEAF} AS leaf,
         {_crc32_sql("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL AS changed,
         {_LEAF.replace("n_chars", "(n_chars + 1)")} AS tampered FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
t AS (SELECT tree, 0 AS level, idx, leaf AS h, n FROM a
      UNION ALL
      SELECT * FROM (SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2
                     FROM t WHERE n > 1 GROUP BY tree, level, idx // 2)),
s AS (SELECT tree, h AS subroot, level AS depth, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, idx, subroot AS h, n FROM s
      UNION ALL
      SELECT * FROM (SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2
                     FROM u WHERE n > 1 GROUP BY level, idx // 2)),
up AS (SELECT s.tree, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, s.depth,
              coalesce(list({{'b': b.h, 'left': b.idx < (s.idx >> b.level)}} ORDER BY b.level) FILTER (b.h IS NOT NULL OR l.level IS NOT NULL), []) AS steps
       FROM s LEFT JOIN (SELECT DISTINCT level FROM u WHERE n > 1) l ON true LEFT JOIN u b ON b.level = l.level AND b.idx = xor(s.idx >> l.level, 1) GROUP BY ALL),
low AS (SELECT a.r, coalesce(list({{'b': b.h, 'left': b.idx < (a.idx >> b.level)}} ORDER BY l.level) FILTER (l.level IS NOT NULL), []) AS steps
        FROM a LEFT JOIN (SELECT DISTINCT tree, level FROM t WHERE n > 1) l ON l.tree = a.tree
        LEFT JOIN t b ON b.tree = a.tree AND b.level = l.level AND b.idx = xor(a.idx >> l.level, 1) GROUP BY ALL),
w AS (SELECT a.*, subroot, root, list_concat(low.steps, up.steps) AS steps FROM a JOIN low USING (r) JOIN up USING (tree))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: coalesce(x.b, '')), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, list_reduce(list_prepend({{'b': CASE WHEN changed THEN tampered ELSE leaf END, 'left': false}}, steps),
             lambda x, y: {{'b': sha256(CASE WHEN y.b IS NULL THEN x.b WHEN y.left THEN y.b || x.b ELSE x.b || y.b END), 'left': false}}).b AS folded_root FROM w)
"""


@query("op13_merkle_proofs", OP13_SQL)
def op13(spark, sf_dir):
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda n_chars: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    changed = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    # One more than the largest long is a number too.
    later = leaf(F.col("n_chars").cast("decimal(20,0)") + 1)
    rows = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(changed, later).alias("tampered"))
    proven = merkle.prove(rows, "lang", ["doc_id"], "leaf")
    digest = lambda c: F.lower(F.hex(c))
    folded = digest(merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return proven.select("doc_id", digest("leaf").alias("leaf"), digest("subroot").alias("subroot"), digest("root").alias("root"),
                         F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
