"""Message bodies to link ids and directives (SRC-11, SRC-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where a link carries its file id, most specific first.
LINK_PATTERNS = [
    r"https?://drive\.google\.com/file/d/([a-zA-Z0-9_-]{10,})",
    r"https?://drive\.google\.com/drive/u/\d+/file/d/([a-zA-Z0-9_-]{10,})",
    r"https?://drive\.google\.com/open\?id=([a-zA-Z0-9_-]{10,})",
    r"https?://drive\.google\.com/uc\?id=([a-zA-Z0-9_-]{10,})",
    r"https?://drive\.google\.com/drive/(?:u/\d+/)?folders/([a-zA-Z0-9_-]{10,})",
    r"/file/d/([a-zA-Z0-9_-]{10,})",
    r"[?&]id=([a-zA-Z0-9_-]{10,})",
]
REDIRECT = r'(https?://(?:www\.)?google\.com/url\?[^\s"]*)'
TARGET = r"[?&]q=([^&]+)"
DIRECTIVE = r"(?i)\bveto:\s*(clip_\d+)"


def extract_link_ids(messages: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``link_ids``: ids found in the body and in decoded redirect targets, first
    seen first."""
    plain = F.replace(F.col(body), F.lit("&amp;"), F.lit("&"))
    hops = F.transform(F.regexp_extract_all(plain, F.lit(REDIRECT), F.lit(1)),
                       lambda u: F.regexp_extract(u, TARGET, 1))
    # A plus sign is literal here, while url_decode would make it a blank.
    decoded = F.transform(F.filter(hops, lambda q: q != ""), lambda q: F.coalesce(
        F.try_url_decode(F.replace(q, F.lit("+"), F.lit("%2B"))), q))
    ids = F.transform(F.concat(F.array(plain), decoded), lambda text: F.flatten(F.array(
        *[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in LINK_PATTERNS])))
    return messages.withColumn("link_ids", F.array_distinct(F.flatten(ids)))


def extract_directives(messages: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``labels``: distinct lower-cased clip labels to withdraw, sorted."""
    found = F.regexp_extract_all(body, F.lit(DIRECTIVE), F.lit(1))
    return messages.withColumn("labels", F.array_sort(F.array_distinct(F.transform(found, F.lower))))
