"""Small pieces several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the five controls from tab to return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone, so that an extra column of the caller can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def text_of(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; empty for a null, an empty or a blank text."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != F.lit(""))


def word_bytes(text: bytes) -> list[bytes]:
    """The words of UTF-8 bytes: ``bytes.split`` cuts at exactly ``WORD_GAP``."""
    return text.split()


def arrow_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, without decoding them."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()
