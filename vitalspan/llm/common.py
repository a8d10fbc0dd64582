"""Shared column helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of every contract: space and the characters 9 to 13.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, or the empty string for a null."""
    return F.coalesce(F.col(col), F.lit(""))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def word_array(text: Column) -> Column:
    """Words of a non-null text; an empty array if it has none."""
    bare = trimmed(text)
    none = F.array().cast("array<string>")
    return F.when(bare == "", none).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def count_of(text: Column, characters: str) -> Column:
    """How many code points of a text are among the given ones."""
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def free_name(columns: list[str], wanted: str) -> str:
    """A column name that none of the given ones has."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
