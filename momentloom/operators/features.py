"""Per-window signal statistics, novelty and the transcript quality gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col, has_foreign_script, text_features, trigram_repeat
from .intervals import BUCKET_MS, EPISODE
from .scaling import block_of, interval_overlap, keys_equal, point_in_interval, spread_interval

KEYS = ["episode_id", "window_id"]
SPAN = [*KEYS, "start_ms", "end_ms"]


def _spans(windows: DataFrame) -> DataFrame:
    return windows.select(*SPAN)


# -- SIG-1..4 -----------------------------------------------------------------------

def rms_features(windows: DataFrame, rms: DataFrame, width: int = BUCKET_MS) -> DataFrame:
    """Peak and mean level of the finite samples inside each window; windows without any
    have no row."""
    finite = rms.filter(~F.isnan("rms_db") & (F.abs("rms_db") != float("inf")))
    hit = point_in_interval(_spans(windows), finite.select("episode_id", "t_ms", "rms_db"),
                            EPISODE, "start_ms", "end_ms", "t_ms", width)
    return hit.groupBy(*KEYS).agg(F.max("rms_db").alias("rms_peak_db"),
                                  F.avg("rms_db").alias("rms_mean_db"))


def f0_features(windows: DataFrame, f0: DataFrame, width: int = BUCKET_MS) -> DataFrame:
    """Mean, population variance and peak of the voiced samples of each window."""
    voiced = f0.filter(F.col("pitch_hz") > 0).select("episode_id", "t_ms", "pitch_hz")
    hit = point_in_interval(_spans(windows), voiced, EPISODE, "start_ms", "end_ms", "t_ms", width)
    return hit.groupBy(*KEYS).agg(F.avg("pitch_hz").alias("f0_mean_hz"),
                                  F.var_pop("pitch_hz").alias("f0_variance_hz2"),
                                  F.max("pitch_hz").alias("f0_peak_hz"))


AUDIO_CLASSES = ["laughter", "applause", "music", "speech"]


def event_features(windows: DataFrame, events: DataFrame, width: int = BUCKET_MS) -> DataFrame:
    """Mean class scores over the scored audio spans that overlap each window."""
    right = events.select("episode_id", F.col("start_ms").alias("_s"),
                          F.col("end_ms").alias("_e"), *AUDIO_CLASSES)
    hit = interval_overlap(_spans(windows), right, EPISODE, "start_ms", "end_ms", "_s", "_e", width)
    return hit.groupBy(*KEYS).agg(*[F.avg(c).alias(c) for c in AUDIO_CLASSES])


# Class numbers of the audio-event vocabulary that feed each score.
CLASS_SETS = {"speech": [0, 1, 2, 3, 4, 5], "laughter": [13], "applause": [36], "music": [137]}


def class_groups(logits, sets: dict[str, list[int]] | None = None) -> Column:
    """struct of the largest soft-max probability within each class set, 0 when the
    vocabulary lacks the set."""
    v = as_col(logits)
    top = F.array_max(v)
    expd = F.transform(v, lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(expd, F.lit(0.0), lambda a, x: a + x)

    def best(ids):
        probs = [F.try_element_at(expd, F.lit(i + 1)) / total for i in ids]
        return F.greatest(*probs, F.lit(0.0)) if probs else F.lit(0.0)

    return F.struct(*[best(ids).alias(name) for name, ids in (sets or CLASS_SETS).items()])


# -- SIG-6 --------------------------------------------------------------------------

def signal_features(windows: DataFrame, rms: DataFrame | None = None, f0: DataFrame | None = None,
                    events: DataFrame | None = None, width: int = BUCKET_MS) -> DataFrame:
    """``rms_features``, ``f0_features`` and ``event_features`` (as struct audio_events) of the given signals
    in one pass: (episode_id, window_id, start_ms, end_ms, features). Windows without any have no row.

    All signals are one table, a sample being a span that ends where it starts, so the windows
    move once, whatever the number of signals.
    """
    kinds, aggs = [], []
    at = lambda df, kind, *values: df.select(
        "episode_id", F.col("t_ms").alias("_s"), F.col("t_ms").alias("_e"), F.lit(kind).alias("_kind"), *values)
    of = lambda kind, name: F.when(F.col("_kind") == kind, F.col(name))
    if rms is not None:
        kinds.append(at(rms.filter(~F.isnan("rms_db") & (F.abs("rms_db") != float("inf"))), 1, F.col("rms_db").alias("_a")))
        aggs += [F.max(of(1, "_a")).alias("rms_peak_db"), F.avg(of(1, "_a")).alias("rms_mean_db")]
    if f0 is not None:
        kinds.append(at(f0.filter(F.col("pitch_hz") > 0), 2, F.col("pitch_hz").alias("_a")))
        aggs += [F.avg(of(2, "_a")).alias("f0_mean_hz"), F.var_pop(of(2, "_a")).alias("f0_variance_hz2"), F.max(of(2, "_a")).alias("f0_peak_hz")]
    if events is not None:
        kinds.append(events.select("episode_id", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.lit(3).alias("_kind"), *AUDIO_CLASSES))
        means = F.struct(*[F.avg(of(3, c)).alias(c) for c in AUDIO_CLASSES])
        aggs.append(F.when(F.count(of(3, "_kind")) > 0, means).alias("audio_events"))
    right = reduce(lambda a, b: a.unionByName(b, True), kinds)
    spread, cond, _ = keys_equal(right.withColumn("_blk", spread_interval("_s", "_e", width)), ["episode_id", "_blk"])
    left = _spans(windows).withColumn("_blk", spread_interval("start_ms", "end_ms", width))
    sample = F.col("_kind") < 3
    cond = (cond & (F.col("end_ms") > F.col("_s")) & ((F.col("start_ms") < F.col("_e")) | (sample & (F.col("start_ms") == F.col("_s"))))
            & (F.col("_blk") == block_of(F.greatest("start_ms", "_s"), width)))
    # Windows made from a small table are taken for small, however many they are; the size check would broadcast them.
    return left.hint("merge").join(spread, cond).groupBy(*SPAN).agg(*aggs)


def build_candidates(windows: DataFrame, rms: DataFrame | None = None,
                     f0: DataFrame | None = None, novelty: DataFrame | None = None,
                     events: DataFrame | None = None, width: int = BUCKET_MS,
                     spans: DataFrame | None = None) -> DataFrame:
    """The wide candidate row: text features plus every signal on hand, NULL if absent.

    ``spans``: the windows again without their texts, if ``windows`` is expensive. Signals join on
    the whole span, as ``window_words`` groups it (novelty too, if it has the bounds), so texts
    don't move again, and they are measured where they end up.
    """
    out = windows
    if rms is not None or f0 is not None or events is not None:
        out = out.join(signal_features(windows if spans is None else spans, rms, f0, events, width), SPAN, "left")
    if novelty is not None:
        on = [c for c in SPAN if c in novelty.columns]
        out = out.join(novelty.select(*on, "novelty"), on, "left")
    absent = {"rms_peak_db": "double", "rms_mean_db": "double", "f0_mean_hz": "double",
              "f0_variance_hz2": "double", "f0_peak_hz": "double", "novelty": "double",
              "audio_events": "struct<laughter:double,applause:double,music:double,speech:double>"}
    for name, kind in absent.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return text_features(out, "transcript")


# -- NOV-1..4 -----------------------------------------------------------------------

TINY = 1e-9   # fixed value: smallest norm and smallest novelty range


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    na, nb = F.sqrt(_dot(a, a)), F.sqrt(_dot(b, b))
    return F.when((na < TINY) | (nb < TINY), 0.0).otherwise(_dot(a, b) / (na * nb))


def mean_vector(vectors: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """(keys, n, mean): element-wise mean; NULL where vectors are empty or NULL, differ in
    length or have NULL elements.

    Vectors are added up as they are, on the map side too (one buffer per key and length), so a
    group of any size is never gathered.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = F.col(vector)
    whole = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())
    dense = vectors.filter(whole).select(*keys, F.size(v).alias("_d"), array_to_vector(v.cast("array<double>")).alias("_v"))
    sums = dense.groupBy(*keys, "_d").agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    sums = sums.select(*keys, "_n", vector_to_array("_m").alias("_m"), F.lit(0).alias("_bad"))
    rest = vectors.filter(~whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_n", F.lit(None).cast("array<double>").alias("_m"), F.lit(1).alias("_bad"))
    per = sums.unionByName(rest).groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("_kinds"), F.first("_m").alias("_m"), F.max("_bad").alias("_bad"))
    return per.select(*keys, "n", F.when((F.col("_kinds") == 1) & (F.col("_bad") == 0), F.col("_m")).alias("mean"))


def novelty(vectors: DataFrame) -> DataFrame:
    """Distance of each window's vector from its episode's centroid, scaled to 0..1
    within the episode. One window, or ragged vectors, give 0. Bounds of the windows stay, if
    ``vectors`` has them."""
    own = [c for c in SPAN if c in vectors.columns]
    center = mean_vector(vectors, EPISODE).select("episode_id", "mean")
    dist = (vectors.join(center, "episode_id")
            .withColumn("_d", 1.0 - cosine("v", "mean"))
            .select(*own, "_d", F.col("mean").isNotNull().alias("_ok")))
    span = dist.groupBy("episode_id").agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    scaled = (F.col("_d") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(TINY))
    return (dist.join(span, "episode_id")
            .select(*own, F.when(F.col("_ok"), scaled).otherwise(0.0).alias("novelty")))


def embed(texts: DataFrame, text_col: str, fn=None, dim: int = 256, out: str = "v") -> DataFrame:
    """Text to vector. ``fn`` is any vectorised (pandas) UDF from string to
    array<float>; the default hashes words, weighs them by inverse document frequency and
    normalises, all with Spark ML."""
    if fn is not None:
        return texts.withColumn(out, fn(F.col(text_col)))
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from ..functions.text import tokens
    prepared = texts.withColumn("_tok", tokens(F.lower(F.coalesce(F.col(text_col), F.lit("")))))
    stages = Pipeline(stages=[
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit")])
    return (stages.fit(prepared).transform(prepared)
            .withColumn(out, vector_to_array("_unit", "float32"))
            .drop("_tok", "_tf", "_idf", "_unit"))


# -- QLT-1 --------------------------------------------------------------------------

# Fixed values: (3-gram repeats tolerated, seconds from which density counts, least
# words per second) for each strictness.
GUARDS = {"lax": (4, None, None), "default": (3, 5.0, 0.5), "strict": (2, 3.0, 0.75)}


def flag_reason(text, repeats, n_words, duration_s, guard: str = "default") -> Column:
    """Why a chunk is unusable, NULL when it is fine; the first hit names the reason."""
    limit, min_dur, min_wps = GUARDS[guard]
    reason = (F.when(has_foreign_script(text), "foreign-script")
              .when(as_col(repeats) > limit, "repeated-3-gram"))
    if min_dur is not None:
        n, d = as_col(n_words), as_col(duration_s)
        reason = reason.when((d > min_dur) & (n > 0) & (n / d < min_wps), "density")
    return reason


def flag_chunks(chunks: DataFrame, guard: str = "default") -> DataFrame:
    """``chunks`` (episode_id, chunk_idx, text, n_words, duration_s) plus ``reason``."""
    return (chunks.withColumn("_rep", trigram_repeat("text"))
            .withColumn("reason", flag_reason("text", "_rep", "n_words", "duration_s", guard)).drop("_rep"))


def usable_chunks(chunks: DataFrame, guard: str = "default") -> tuple[DataFrame, DataFrame]:
    """(chunks that contribute words and segments, flagged chunks with their reason)."""
    marked = flag_chunks(chunks, guard)
    return (marked.filter(F.col("reason").isNull()).drop("reason"),
            marked.filter(F.col("reason").isNotNull()))


__all__ = ["rms_features", "f0_features", "event_features", "signal_features", "class_groups",
           "build_candidates", "cosine", "mean_vector", "novelty", "embed", "flag_chunks",
           "flag_reason", "usable_chunks"]
