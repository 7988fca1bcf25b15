"""Text columns: marker counts, sentences, scripts, slugs, hooks and clamps (FN-1..12).

Everything is a Catalyst expression over one text column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marker phrases. Results depend on these exact alternatives.
LEXICON = {
    "conflict_markers": [
        r"no,?\s+wait", r"no,?\s+actually", "hold on", r"wait,?\s+wait",
        "that's not (?:true|right|how)", "but but", "let me finish",
        "that's where you're wrong", "hold up", r"no\s+no\s+no"],
    "strong_claim": [
        "honestly", "the truth is", "hot take", "nobody talks about", "i'm gonna be real",
        "i'm being real", "here's the thing", "the reality is", "let me tell you",
        "i'll tell you what", "the fact is", "real talk"],
    "confessional": [
        "i'?ll be honest", "i'?ve never told", "between us", "to be honest with you",
        "i'?m gonna admit", "i'?m embarrassed", "i hate to admit", "full disclosure"],
    "topic_shift": [
        "so anyway", "speaking of which", "moving on", "on a different note",
        "switching gears", "different topic", "by the way", "on another note"],
}

# Inclusive code-point ranges (hex) of scripts that count as foreign.
FOREIGN_RANGES = [
    ("0590", "05FF"), ("0600", "07FF"), ("0900", "097F"), ("0980", "09FF"),
    ("0A00", "0AFF"), ("0B00", "0BFF"), ("0C00", "0CFF"), ("0D00", "0DFF"),
    ("0E00", "0E7F"), ("0E80", "0EFF"), ("0F00", "0FFF"), ("1000", "109F"),
    ("10A0", "10FF"), ("1100", "11FF"), ("3040", "309F"), ("30A0", "30FF"),
    ("3400", "4DBF"), ("4E00", "9FFF"), ("AC00", "D7AF"), ("F900", "FAFF"),
]

HOOK_WORDS = 5          # fixed value: words kept in an overlay hook
SHORT_SENTENCE = 12     # fixed value: longest "short declarative", in words

_WS = r"(?U)\s+"


def as_col(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Fixed value: the characters Unicode calls white space.
BLANKS = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
          "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def trim_ws(col) -> Column:
    """Trim all Unicode white space, not only blanks. Looks at the ends only."""
    return F.trim(as_col(col), F.lit(BLANKS))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(col) -> Column:
    """White-space separated tokens, none empty."""
    return F.regexp_extract_all(as_col(col), F.lit(r"(?U)(\S+)"), F.lit(1))


def word_count(col) -> Column:
    return F.regexp_count(as_col(col), F.lit(r"(?U)\S+")).cast("bigint")


# -- FN-1, FN-2 ---------------------------------------------------------------------

def phrase_count(col, phrases: list[str]) -> Column:
    # Looking at the first letter before the word boundary skips most of a text cheaply.
    firsts = "".join(sorted({p[0] for p in phrases}))
    skip = f"(?=[{firsts}])" if firsts.isalpha() and firsts.isascii() else ""
    pattern = rf"(?iuU){skip}\b(?:" + "|".join(phrases) + r")\b"
    return F.regexp_count(as_col(col), F.lit(pattern)).cast("bigint")


def marker_counts(col, lexicon: dict[str, list[str]] | None = None) -> dict[str, Column]:
    return {name: phrase_count(col, phrases)
            for name, phrases in (lexicon or LEXICON).items()}


def number_count(col) -> Column:
    return F.regexp_count(as_col(col), F.lit(r"(?U)\b\d[\d,\.]*\b")).cast("bigint")


def question_count(col) -> Column:
    return (F.length(as_col(col)) - F.length(F.replace(as_col(col), F.lit("?")))
            ).cast("bigint")


# -- FN-3, FN-4 ---------------------------------------------------------------------

def sentences(col) -> Column:
    """Sentences without their closing marks, trimmed, none empty."""
    parts = F.split(trim_ws(col), r"(?U)[.!?]+(?:\s+|$)")
    return F.filter(F.transform(parts, trim_ws), lambda s: s != "")


def sentence_lengths(sents: Column) -> Column:
    return F.transform(sents, word_count)


def avg_sentence_words(lengths: Column) -> Column:
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, n: a + n)
    return F.when(F.size(lengths) > 0, total / F.size(lengths)).otherwise(F.lit(0.0))


def short_declaratives(sents: Column) -> Column:
    """Structs (n words, position, text) of the short sentences without a ``?``."""
    rows = F.transform(sents, lambda s, i: F.struct(
        word_count(s).alias("n"), i.alias("pos"), s.alias("text")))
    return F.filter(rows, lambda r: ~F.contains(r["text"], F.lit("?"))
                    & (r["n"] > 0) & (r["n"] <= SHORT_SENTENCE))


def quotable_lines(shorts: Column, n: int = 2) -> Column:
    return F.transform(F.slice(F.array_sort(shorts), 1, n), lambda r: r["text"])


def text_features(df: DataFrame, text_col: str, out: str = "linguistic",
                  lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """FN-1..4 over any text table: adds one struct column.

    Sentences are split once and reused through a temporary column.
    """
    df = (df.withColumn("_t", trim_ws(F.coalesce(F.col(text_col), F.lit(""))))
          .withColumn("_sents", sentences("_t")))
    df = (df.withColumn("_lens", sentence_lengths(F.col("_sents")))
          .withColumn("_shorts", short_declaratives(F.col("_sents"))))
    fields = [word_count("_t").alias("total_words"),
              F.size("_sents").cast("bigint").alias("sentence_count"),
              avg_sentence_words(F.col("_lens")).alias("avg_sentence_words")]
    fields += [c.alias(name) for name, c in marker_counts("_t", lexicon).items()]
    fields += [question_count("_t").alias("questions"),
               number_count("_t").alias("numbers"),
               F.size("_shorts").cast("bigint").alias("short_declaratives"),
               quotable_lines(F.col("_shorts")).alias("quotable_lines")]
    return (df.withColumn(out, F.struct(*fields))
            .drop("_t", "_sents", "_lens", "_shorts"))


# -- FN-5, FN-6 ---------------------------------------------------------------------

def has_foreign_script(col) -> Column:
    merged: list[list[int]] = []
    for a, b in sorted((int(a, 16), int(b, 16)) for a, b in FOREIGN_RANGES):
        if merged and a == merged[-1][1] + 1:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    cls = "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in merged)
    return as_col(col).rlike(f"[{cls}]")


def trigrams(col) -> Column:
    """Lower-cased word 3-grams in order; none below six tokens."""
    def of(toks):
        grams = F.transform(F.slice(toks, F.lit(3), F.greatest(F.size(toks) - 2, F.lit(0))), lambda t, i: F.concat_ws(
            " ", F.get(toks, i), F.get(toks, i + 1), t))
        return F.when(F.size(toks) >= 6, grams).otherwise(F.array().cast("array<string>"))

    return let(tokens(F.lower(as_col(col))), of)


def trigram_repeat(col) -> Column:
    """How often the most frequent 3-gram of a text occurs, 0 below six tokens: the row's
    3-grams sorted, then one pass over the equal runs. No row leaves its task."""
    start = F.struct(F.lit("").alias("g"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("best"))

    def step(acc, gram):
        n = F.when(acc["g"] == gram, acc["n"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(gram.alias("g"), n.alias("n"), F.greatest(acc["best"], n).alias("best"))

    return F.aggregate(F.array_sort(trigrams(col)), start, step, lambda acc: acc["best"])


def max_trigram_repeat(df: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """(key, max_repeat) for a text table."""
    return df.select(*key, trigram_repeat(text_col).alias("max_repeat"))


def fixed(col, digits: int) -> Column:
    """A number with ``digits`` decimals, rounding the exact binary value half to even
    (``format_string`` would round the shortest decimal text half up instead). Between half
    a unit and one unit of the last place the JVM's rule is off, so that is spelled out."""
    x = as_col(col).cast("double")
    shown = F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))
    if not digits:
        return shown
    unit = "0." + "0" * (digits - 1) + "1"
    near = (F.abs(x) >= float(unit) / 2) & (F.abs(x) < float(unit))
    return F.when(near, F.when(x < 0, "-" + unit).otherwise(unit)).otherwise(shown)


# -- FN-7..12 -----------------------------------------------------------------------

def slugify(col) -> Column:
    folded = F.regexp_replace(as_col(col), "[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(folded, "^_+|_+$", ""))


def fmt_mmss(secs) -> Column:
    s = F.greatest(as_col(secs), F.lit(0)).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def fmt_hms(secs) -> Column:
    s = F.greatest(as_col(secs), F.lit(0)).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return (F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r))
            .otherwise(F.format_string("%dm %02ds", m, r)))


def fmt_duration(secs) -> Column:
    s = F.greatest(as_col(secs), F.lit(0)).cast("bigint")
    return F.format_string("%dm %ds", F.floor(s / 60), s % 60)


def fmt_iso(unix_secs) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(as_col(unix_secs)),
                                  "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def clean_hook(col) -> Column:
    words = F.slice(tokens(F.coalesce(as_col(col), F.lit(""))), 1, HOOK_WORDS)
    return F.regexp_replace(F.array_join(words, " "), r"\.+$", "")


def hook_mode(raw) -> Column:
    """Normalise a configured hook source; anything unknown means ``llm``."""
    v = F.lower(trim_ws(raw))
    return (F.when(v == "ranker", "ranker")
            .when(v.isin("ab_test", "ab", "abtest"), "ab_test").otherwise("llm"))


def resolve_hook(written, ranked, mode, idx) -> Column:
    """struct(hook, source) for a written hook, a ranking hook, a mode and a 0-based
    clip position; the A/B mode gives even positions the written hook."""
    a, b, mode = clean_hook(written), clean_hook(ranked), as_col(mode)
    use_written = (mode == "llm") | ((mode == "ab_test") & (as_col(idx) % 2 == 0))
    return F.struct(
        F.when(use_written & (a != ""), a).otherwise(b).alias("hook"),
        F.when(use_written & (a != ""), "llm").when(use_written, "fallback")
        .otherwise("ranker").alias("source"))


def clamp_chars(col, n: int, style: str = "cut") -> Column:
    """Limit to ``n`` characters: ``cut``, ``dots`` (n-3 plus ...), ``ellipsis`` (n-1
    plus a single ellipsis character)."""
    def cut(c):
        short = {"cut": lambda: F.substring(c, 1, n),
                 "dots": lambda: F.concat(F.substring(c, 1, n - 3), F.lit("...")),
                 "ellipsis": lambda: F.concat(F.substring(c, 1, n - 1), F.lit("…"))}[style]()
        return F.when(F.char_length(c) <= n, c).otherwise(short)

    return cut(F.col(col)) if isinstance(col, str) else let(col, cut)


def clamp_score(col) -> Column:
    return F.least(F.greatest(as_col(col), F.lit(0)), F.lit(100))


def blend(first, second, weight: float) -> Column:
    """Weighted mean of two scores, rounded half away from zero, within 0..100."""
    mixed = F.round(F.lit(1.0 - weight) * as_col(first) + F.lit(weight) * as_col(second))
    return clamp_score(mixed.cast("bigint"))


# -- FN-15, FN-16 -------------------------------------------------------------------

# Accepted spellings of each target.
API_PLATFORMS = {"youtube": ["youtube", "yt", "shorts"], "bluesky": ["bluesky", "bsky"],
                 "instagram": ["instagram", "ig", "reels"], "ayrshare": ["ayrshare"]}
BROWSER_PLATFORMS = {
    "x": ["x", "twitter"], "linkedin": ["linkedin", "li"], "threads": ["threads"],
    "tiktok": ["tiktok", "tt"],
    "instagram_browser": ["instagram_browser", "ig_browser", "instagram_b"],
    "youtube_browser": ["youtube_browser", "yt_browser"],
    "bluesky_browser": ["bluesky_browser", "bsky_browser"]}
RENDER_FORMATS = {"9x16": ["9x16", "vertical", "shorts"], "1x1": ["1x1", "square"],
                  "16x9": ["16x9", "landscape", "horizontal"]}
MEDIA_ROOT = "/clipper/"   # fixed value: path part that precedes a stored object's key
VIDEO_EXTENSIONS = ["mp4", "mov", "mkv", "webm", "m4v", "avi"]


def canonical(col, aliases: dict[str, list[str]]) -> Column:
    """Canonical name of a token, NULL when unknown."""
    pairs = [(a, name) for name, spellings in aliases.items() for a in spellings]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(table, F.lower(trim_ws(col)))


def parse_platforms(col) -> Column:
    """Comma list -> distinct canonical platforms in first-seen order."""
    names = F.transform(F.split(as_col(col), ","), lambda t: canonical(t, API_PLATFORMS))
    return F.array_distinct(F.filter(names, lambda t: t.isNotNull()))


def parse_formats(col) -> Column:
    """Comma list -> canonical formats. Only equal spellings are merged, so
    ``vertical,9x16`` names the same format twice."""
    raw = F.array_distinct(F.transform(F.split(as_col(col), ","),
                                       lambda t: F.lower(trim_ws(t))))
    names = F.transform(raw, lambda t: canonical(t, RENDER_FORMATS))
    return F.filter(names, lambda t: t.isNotNull())


def _pairs(col) -> Column:
    cut = F.transform(F.split(as_col(col), ","), lambda t: F.struct(
        trim_ws(F.substring_index(t, ":", 1)).alias("platform"),
        trim_ws(F.regexp_replace(t, "^[^:]*:", "")).alias("account"),
        F.contains(t, F.lit(":")).alias("ok")))
    return F.filter(cut, lambda p: p["ok"] & (p["platform"] != "") & (p["account"] != ""))


def parse_accounts(accounts, primaries) -> Column:
    """``platform:account`` lists -> array<struct(platform, account, is_primary)>.

    With no explicit primaries the first account of each platform is the primary one.
    """
    named = F.transform(_pairs(accounts), lambda p: F.struct(
        canonical(p["platform"], BROWSER_PLATFORMS).alias("platform"),
        p["platform"].alias("raw"), p["account"].alias("account")))
    known = F.filter(named, lambda p: p["platform"].isNotNull())
    chosen = F.transform(_pairs(primaries), lambda p: F.concat(
        p["platform"], F.lit(":"), p["account"]))
    platforms = F.transform(known, lambda p: p["platform"])
    return F.transform(known, lambda p, i: F.struct(
        p["platform"].alias("platform"), p["account"].alias("account"),
        F.when(F.size(chosen) == 0, F.array_position(platforms, p["platform"]) == i + 1)
        .otherwise(F.array_contains(chosen, F.concat(p["platform"], F.lit(":"), p["account"]))
                   | F.array_contains(chosen, F.concat(p["raw"], F.lit(":"), p["account"])))
        .alias("is_primary")))


def is_video(col) -> Column:
    return F.lower(as_col(col)).rlike(r"\.(" + "|".join(VIDEO_EXTENSIONS) + ")$")


def url_filename(col) -> Column:
    last = F.substring_index(F.substring_index(as_col(col), "?", 1), "/", -1)
    return F.when(last != "", last)


def object_key(path, prefix: str = "", marker: str = MEDIA_ROOT) -> Column:
    """Key under ``prefix``: what follows the first marker, up to a second one."""
    parts = F.split(as_col(path), marker)
    rel = F.regexp_replace(F.when(F.size(parts) > 1, F.get(parts, F.lit(1)))
                           .otherwise(as_col(path)), "^/+", "")
    return F.concat(F.lit(f"{prefix}/" if prefix else ""), rel)
