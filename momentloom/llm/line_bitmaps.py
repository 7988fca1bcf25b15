"""Lines that many documents share, removed by bitmaps instead of text.

A line is known by the hashes of its key (the line without white space at its ends, A-Z
lower-cased). Rows of (hashes, document, position) are range-partitioned by the hashes and sorted
by document, largest first, and position; a window streams over them, so the first document of a
key is the one that keeps its lines. What comes back for a document is a bitmap of the lines to
keep; no text is shuffled to find them. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from momentloom.llm.common import only, text_of
from momentloom.session import stage

#: Code points a key needs, and documents that have to hold it.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Rows of one key that a task streams without splitting the key. Keys with more rows than this and
#: than 1/HOT_SHARE of all rows are hot, of which there are fewer than HOT_SHARE.
HOT_ROWS, HOT_SHARE = 2_000, 1_024
#: Counters of the pass that finds hot keys.
COUNTERS = 1 << 16
#: Lines of a word of a bitmap.
WORD = 64
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY, _ROW = ["h1", "h2"], ["doc_id", "t1", "t2"]


def _hashes(col: Column) -> list[Column]:
    """Two independent 64-bit hashes of the whole value."""
    return [F.xxhash64(col), F.xxhash64(F.lit("second"), col)]


def _folded(text: Column) -> Column:
    """Only A-Z lower-cased; ``lower`` does just that to a text of ASCII letters."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def with_row_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and the hashes t1, t2 of the text: rows equal in all of them are
    alike in every result too."""
    rows = only(docs, "doc_id", text).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    first, second = _hashes(F.col("text"))
    return rows.select("doc_id", "text", first.alias("t1"), second.alias("t2"))


def key_rows(rows: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """h1, h2, doc_id, t1, t2, pos for each line of ``with_row_keys`` whose key is long enough."""
    lines = rows.filter(F.col("doc_id").isNotNull()).select(*_ROW, F.posexplode(F.split(_folded(F.col("text")), "\n", -1)).alias("pos", "_line"))
    keys = lines.select(*_ROW, "pos", F.btrim("_line", F.lit(_SPACE)).alias("_key")).filter(F.char_length("_key") >= least_chars)
    first, second = _hashes(F.col("_key"))
    return keys.select(first.alias("h1"), second.alias("h2"), *_ROW, "pos")


def hot_keys(lines: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """h1, h2, _docs, _keeper of the keys with more rows than ``hot_rows`` and than 1/HOT_SHARE of
    all: fewer than HOT_SHARE rows.

    Counters by a part of the hash, added up before the shuffle, leave fewer than HOT_SHARE
    crowded counters; only the keys behind them are grouped.
    """
    limit = max(hot_rows, lines.count() // HOT_SHARE)
    counter = F.col("h1").bitwiseAND(F.lit(COUNTERS - 1).cast("bigint"))
    crowded = [r.c for r in lines.groupBy(counter.alias("c")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("c").collect()]
    per_doc = lines.filter(counter.isin(crowded) if crowded else F.lit(False)).groupBy(*_KEY, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return (per_doc.groupBy(*_KEY).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_docs"), F.max("doc_id").alias("_keeper"))
            .filter(F.col("_n") > limit).select(*_KEY, "_docs", "_keeper"))


def dropped_lines(lines: DataFrame, least_docs: int = LEAST_DOCS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, t1, t2, pos of the lines to drop. ``lines`` is read several times: stage it."""
    hot = F.broadcast(stage(hot_keys(lines, hot_rows), "hot-lines"))
    crowded = lines.join(hot, _KEY).filter((F.col("_docs") >= least_docs) & (F.col("doc_id") < F.col("_keeper")))
    # The range partitions of the hashes serve the windows too: one shuffle, sorted once.
    ordered = [*_KEY, F.col("doc_id").desc(), "pos"]
    sorted_rows = lines.join(hot.select(*_KEY), _KEY, "left_anti").repartitionByRange(*_KEY).sortWithinPartitions(*ordered)
    nth = F.dense_rank().over(W.partitionBy(*_KEY).orderBy(F.col("doc_id").desc()))
    streamed = sorted_rows.withColumn("_nth", nth).withColumn("_docs", F.max("_nth").over(W.partitionBy(*_KEY)))
    rest = streamed.filter((F.col("_nth") > 1) & (F.col("_docs") >= least_docs))
    return crowded.select(*_ROW, "pos").unionByName(rest.select(*_ROW, "pos"))


def keep_bitmaps(docs: DataFrame, text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, t1, t2, keep for the documents that lose lines.

    keep is compressed: words of 64 lines as structs (word, bits) in order, those with all bits set
    left out; bit i of word w is set if line 64 * w + i stays. t1 and t2 are the hashes of
    ``with_row_keys``. A document is a doc_id: a key on several rows of one doc_id counts once, and
    in the largest doc_id that holds a key all its lines stay. Rows without doc_id lose nothing and
    don't count. A null text is empty. Equal rows give one bitmap. Other columns are not carried.
    """
    lines = stage(key_rows(with_row_keys(docs, text), least_chars), "line-keys")
    bit = F.expr(f"shiftleft(1L, pos % {WORD})")
    words = (dropped_lines(lines, least_docs, hot_rows).groupBy(*_ROW, F.floor(F.col("pos") / WORD).cast("int").alias("word"))
             .agg(F.bit_or(bit).alias("_gone")))
    kept = F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("_gone").alias("bits"))))
    return words.groupBy(*_ROW).agg(kept.alias("keep"))


def _dense(keep: Column) -> Column:
    """All words up to the last stored one."""
    before = lambda i: F.when(i == 0, -1).otherwise(F.get(keep, i - 1)["word"])
    filled = F.transform(keep, lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("bigint"), w["word"] - before(i) - 1), F.array(w["bits"])))
    return F.flatten(filled)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, per row of ``docs``."""
    rows = with_row_keys(docs, text)
    left = rows.filter(F.col("doc_id").isNotNull()).join(bitmaps, _ROW, "left")
    none = F.lit(None).cast(bitmaps.schema["keep"].dataType)
    every = left.select("doc_id", "text", "keep").unionByName(rows.filter(F.col("doc_id").isNull()).select("doc_id", "text", none.alias("keep")))
    cut = every.select("doc_id", "text", F.split("text", "\n", -1).alias("_lines"), _dense(F.col("keep")).alias("_words"), "keep")
    stays = lambda i: F.coalesce(F.get("_words", F.floor(i / WORD).cast("int")), F.lit(-1).cast("bigint"))
    # getbit of a position below 64; the sign bit is the last line of a word.
    kept = F.filter("_lines", lambda line, i: F.getbit(stays(i), i % WORD) == 1)
    gone = F.aggregate("keep", F.lit(0).cast("bigint"), lambda n, w: n + WORD - F.bit_count(w["bits"]))
    return cut.select("doc_id", F.size("_lines").cast("bigint").alias("n_lines"), F.coalesce(gone, F.lit(0).cast("bigint")).alias("n_dropped"),
                      F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
