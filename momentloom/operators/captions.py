"""Caption phrases with karaoke timing (CAP-1..3)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col, trim_ws

# Fixed values: (most words, most characters) of a phrase for each picture shape.
SHAPES = {"9x16": (4, 28), "1x1": (5, 36), "16x9": (7, 52)}


def _phrase_starts(max_words: int, max_chars: int):
    """(first word from 1, sentence, phrase) of the phrases of each list of word lengths, negative behind the
    end of a sentence: a word that would exceed a limit opens the next phrase, one behind the end of
    a sentence the next sentence."""
    @F.arrow_udf("array<struct<first:int,sentence:bigint,phrase:bigint>>")
    def starts(sizes: pa.Array) -> pa.Array:
        flat = sizes.flatten().to_pylist()
        bounds, first, sentences, phrases, at = [0], [], [], [], 0
        for n in sizes.value_lengths().to_pylist():
            sentence, phrase, words, chars, closed = 0, 0, 0, 0, False
            for i, size in enumerate(flat[at:at + n], 1):
                length = abs(size)
                if closed:
                    sentence, phrase, words = sentence + 1, 0, 0
                elif words and (words >= max_words or chars + 1 + length > max_chars):
                    phrase, words = phrase + 1, 0
                if words:
                    words, chars = words + 1, chars + 1 + length
                else:
                    words, chars = 1, length
                    first.append(i)
                    sentences.append(sentence)
                    phrases.append(phrase)
                closed = size < 0
            at += n
            bounds.append(len(first))
        rows = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(sentences, pa.int64()), pa.array(phrases, pa.int64())], ["first", "sentence", "phrase"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)

    return starts


def caption_phrases(words: DataFrame, max_words: int = 4, max_chars: int = 28) -> DataFrame:
    """(clip_id, sentence, phrase, start_ms, end_ms, n_words, text, karaoke) from clip words
    (clip_id, pos, text, start_ms, end_ms).

    A word ending in . ! ? closes its phrase and its sentence. The words of a clip, which its length
    bounds, are one array; phrases are slices of it, so there is one shuffle. Only the lengths of
    the words go through Python, which says where phrases begin.
    Phrases without positive length are dropped.
    """
    limit_words, limit_chars = max(max_words, 1), max(max_chars, 8)
    spoken = words.withColumn("text", trim_ws("text")).filter(F.col("text") != "")
    size = F.char_length("text")
    slim = F.struct(F.col("pos").cast("bigint").alias("pos"), "text", F.col("start_ms").cast("bigint").alias("start_ms"),
                    F.col("end_ms").cast("bigint").alias("end_ms"), F.when(F.col("text").rlike(r"[.!?]$"), -size).otherwise(size).alias("_size"))
    clips = spoken.groupBy("clip_id").agg(F.array_sort(F.collect_list(slim)).alias("_ws"))
    clips = clips.withColumn("_firsts", _phrase_starts(limit_words, limit_chars)(F.transform("_ws", lambda w: w["_size"])))
    phrases = F.transform("_firsts", lambda f, k: F.struct(
        f.alias("at"), F.slice("_ws", f["first"], F.coalesce(F.get("_firsts", k + 1)["first"], F.size("_ws") + 1) - f["first"]).alias("_w")))
    per = clips.select("clip_id", F.inline(phrases)).select("clip_id", "at.sentence", "at.phrase", "_w")
    first, last = F.element_at("_w", 1), F.element_at("_w", -1)
    out = per.select("clip_id", "sentence", "phrase", first["start_ms"].alias("start_ms"), last["end_ms"].alias("end_ms"),
                     F.size("_w").cast("bigint").alias("n_words"), F.array_join(F.transform("_w", lambda x: x["text"]), " ").alias("text"),
                     karaoke(F.col("_w")).alias("karaoke"))
    return out.filter(F.col("end_ms") > F.col("start_ms"))


def _one_line(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit(" "))


def karaoke(words: Column) -> Column:
    """Text with a fill time in hundredths of a second before each word; plain text when
    the words of a longer phrase have no times of their own."""
    first = F.element_at(words, 1)["start_ms"]
    timed = (F.size(words) == 1) | F.exists(words, lambda w: F.abs(w["start_ms"] - first) > 1)

    def fill(w):
        hundredths = F.floor((F.greatest(w["end_ms"] - w["start_ms"], F.lit(0)) + 5) / 10)
        return F.concat(F.lit("{\\k"), hundredths.cast("string"), F.lit("}"), _one_line(w["text"]))

    plain = F.array_join(F.transform(words, lambda w: w["text"]), " ")
    escaped = F.replace(F.replace(_one_line(plain), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    return F.when(timed, F.array_join(F.transform(words, fill), " ")).otherwise(escaped)


def caption_time(ms) -> Column:
    """h:mm:ss.cc, rounded to hundredths."""
    cs = F.floor((F.greatest(as_col(ms), F.lit(0)) + 5) / 10)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360_000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)
