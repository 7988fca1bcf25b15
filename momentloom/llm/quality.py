"""Quality rules whose cutoffs carry a proof: few clean documents are rejected.

Every document gets a severity, the worst of its rule scores measured in units of the rules'
customary limits. Labelled documents (the holdout; no rule is fitted on it) show how many clean
ones each cutoff would reject. A cutoff is certified for a stratum if the exact binomial tail
says that its false rejection rate is at most ``alpha``, with confidence 1 - ``delta`` for all
strata together. DataFrame functions only.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.llm.common import words_of
from momentloom.session import stage

#: Customary limits of the rules, a score of 1 unit each.
SYMBOLS_PER_WORD = 0.1
REPEATED_WORDS = 0.5
DUPLICATE_LINES = 0.5
CAPITALS_PER_LETTER = 0.4
LETTERS_PER_WORD = 16.0
#: Cutoffs tried, from the mildest to the strictest: STEPS / 4 units down to 1 / 4 unit.
STEPS = 32
BASE_WORDS = 50

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "severity")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns ``FEATURES`` to ``docs``; other columns stay, unless they have those names.

    Words are cut at ASCII white space. ``n_repeat_words`` counts the words inside three-word
    windows found twice or more in the text; windows are told apart by 64-bit hashes. A null,
    empty or blank text has no words and severity 0. Everything is computed inside the row; sorts
    of hashes run only for texts that repeat a window.
    """
    kept = [c for c in docs.columns if c not in FEATURES]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    rows = rows.withColumn("_w", words_of(F.col("_t"))).withColumn("_n", F.size("_w").cast("bigint"))
    window = F.transform(F.sequence(F.lit(0), F.size("_w") - 3),
                         lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    rows = rows.withColumn("_h", F.when(F.size("_w") >= 4, window))
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, j: (F.get("_s", j)["h"] == x["h"])
    rows = rows.withColumn("_p", F.sort_array(F.filter(F.transform(
        "_s", lambda x, j: F.when(F.coalesce(near(x, j + 1), F.lit(False)) | F.coalesce(F.when(j > 0, near(x, j - 1)), F.lit(False)), x["i"])),
        lambda p: p.isNotNull())))
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1) - p, F.lit(3)))),
                          F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = rows.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        *[F.col(f"`{c}`") for c in kept], "_t", F.col("_n").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("_l").alias("_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).alias("_upper"), F.regexp_count("_t", F.lit(r"\p{L}")).alias("_letters"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    severity = F.greatest(share("n_symbols", "n_words") / SYMBOLS_PER_WORD, share("n_repeat_words", "n_words") / REPEATED_WORDS,
                          share("n_dup_lines", "_lines") / DUPLICATE_LINES, share("_upper", "_letters") / CAPITALS_PER_LETTER,
                          share("word_chars", "n_words") / LETTERS_PER_WORD)
    return rows.select(*[F.col(f"`{c}`") for c in kept], *FEATURES[:-1], severity.alias("severity"))


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for a binomial (n, p), summed term by term in logarithms; 1 from the mean on."""
    first = F.struct((n * F.lit(log(1 - p))).alias("t"), (n * F.lit(log(1 - p))).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log((n - i) / (i + 1)) + F.lit(log(p / (1 - p)))
        high = F.greatest(acc["s"], term)
        return F.struct(term.alias("t"), (high + F.log(F.exp(acc["s"] - high) + F.exp(term - high))).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(0).cast("bigint"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < n * p, F.exp(F.aggregate(steps, first, add, lambda a: a["s"]))).otherwise(F.lit(1.0))


def certify(features: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Per stratum with a certified cutoff: stratum, cutoff (in units), n_clean, n_rejected.

    ``labels`` (doc_id, quality 1: clean, 0: not) name the holdout; rows with a null are left
    out, and of contrary labels for a document the lower counts. Cutoffs are tested in fixed
    order from mild to strict at level ``delta`` / number of strata (fixed-sequence testing
    inside, Bonferroni across strata), so every cutoff before the first failure is certified. Of
    those the one with the largest gain, unclean less clean documents rejected, is chosen, the
    mildest of equals; a stratum where none has a gain has no row, and nothing is rejected there.
    """
    marks = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("_clean"))
    rows = features.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                           F.least(F.ceil(F.col("severity") * 4), F.lit(STEPS + 1)).cast("int").alias("_b"))
    counts = (rows.join(marks, "doc_id").groupBy("stratum", "_b")
              .agg(F.count_if(F.col("_clean") == 1).alias("_g"), F.count_if(F.col("_clean") != 1).alias("_u")))
    # A row of this table is a stratum and a step: small whatever the corpus.
    steps = (counts.withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(STEPS))))
             .groupBy("stratum", "_j").agg(F.sum("_g").alias("n_clean"), F.sum(F.when(F.col("_b") > F.col("_j"), F.col("_g")).otherwise(0)).alias("n_rejected"),
                                           F.sum(F.when(F.col("_b") > F.col("_j"), F.col("_u")).otherwise(0)).alias("_caught")))
    tests = (steps.groupBy("stratum").agg(F.collect_list(F.struct("_j", "n_clean", "n_rejected", "_caught")).alias("_js"))
             .withColumn("_strata", F.count(F.lit(1)).over(_everything()))
             .select("stratum", "_strata", F.inline("_js")))
    sure = tests.filter((F.col("n_clean") > 0) & (_tail(F.col("n_rejected"), F.col("n_clean"), alpha) * F.col("_strata") <= delta)
                        & (F.col("_caught") > F.col("n_rejected")))
    best = sure.groupBy("stratum").agg(F.max(F.struct(F.col("_caught") - F.col("n_rejected"), "_j", "n_clean", "n_rejected")).alias("_m"))
    return best.select("stratum", (F.col("_m._j") / 4.0).alias("cutoff"), "_m.n_clean", "_m.n_rejected")


def _everything():
    """One window over a row per stratum, of which there are few."""
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(0))


def with_verdict(rows: DataFrame, cutoffs: DataFrame, stratum: str = "lang", out: str = "kept") -> DataFrame:
    """``rows`` of ``with_features`` with ``out``: true for a row that the base rules and its stratum's
    cutoff keep. Cutoffs are written and joined, however many; Spark sends a small table to the rows."""
    limits = stage(cutoffs.select(F.col("stratum").alias("_stratum"), F.col("cutoff").alias("_cutoff")), "cutoffs")
    found = rows.join(limits, F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")) == F.col("_stratum"), "left")
    kept = ~base_failed() & ~F.coalesce(F.col("severity") > F.col("_cutoff"), F.lit(False))
    return found.withColumn(out, kept).drop("_stratum", "_cutoff")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that the rules keep; the labelled of them are the holdout.

    Features are computed in the row, once for the cutoffs and once for the verdict, so that no
    text is shuffled or stored for them.
    """
    rows = with_features(docs)
    judged = with_verdict(rows, certify(rows, labels, stratum, alpha, delta), stratum, "_kept")
    # Not a filter: the optimizer would copy the features' expressions into it, again and again.
    once = F.explode(F.when(F.col("_kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns], once.alias("_once")).drop("_once")
