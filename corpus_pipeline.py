"""A training-text pipeline over ``documents``: each stage is written, reread
and handed to the next. All stages but the last return the columns of
``documents``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.llm import line_templates, mixing, near_dedup, packing, quality_rules
from vitalspan.llm.common import free_name, table, text_of, word_array
from vitalspan.session import configure, materialize

#: No stage but the first and fourth could be stated in SQL, so there is none.
ORACLE_SQL: str | None = None


def _with_keys(docs: DataFrame, kept: DataFrame) -> DataFrame:
    key = free_name(docs.columns, "kept_id")
    return docs.join(kept.select(F.col("doc_id").alias(key)), F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the learned rules; of rows with
    equal ids all stay if one does."""
    judged = quality_rules.judge_quality(docs, table(spark, sf_dir, "labels")).where("kept")
    return _with_keys(docs, judged)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; ``n_chars`` follows the text. Documents
    of which nothing but blanks is left, and that lost lines, go."""
    counts = free_name(docs.columns, "line_counts")
    dropped = F.col(counts)["dropped"]
    rows = line_templates.rewritten(docs, counts=counts).where((dropped == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(dropped > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id."""
    return _with_keys(docs, near_dedup.near_duplicates(docs).where("kept"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the balanced mix takes; rows of one
    key with different numbers of words have their own copies."""
    key, size, times, copy = (free_name(docs.columns, n) for n in ("mixed_id", "mixed_size", "mixed_copies", "mixed_copy"))
    mixed = mixing.mix_sources(docs)
    copies = mixed.groupBy(F.col("doc_id").alias(key), F.col("size").alias(size)).agg(F.min("copies").alias(times))
    words = F.size(word_array(text_of())).cast("long")
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(key)) & (words == F.col(size))).where(F.col(times) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(copy)).drop(copy)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i + 1}")
    return docs
