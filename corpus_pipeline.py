"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing, each on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import decontaminate, line_dedup, minhash, packing, toxicity
from cueloom.llm.registry import table, tokenizer_path
from cueloom.session import apply_settings, freeze

#: Documents that score at least this are toxic.
TOXIC = 0.7
#: Documents that share at least this percentage of their word shingles are near duplicates.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC`` by a model of the labelled rows; ids with crc32 mod 3 = 1 never train it."""
    may_learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels, may_learn), TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat; ``n_chars`` follows the text, and emptied documents go."""
    out = line_dedup.dedup_lines(docs, short=True, emptied=False)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (``NEAR``): the one with the smallest doc_id."""
    return minhash.keep_one(docs, NEAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length, with their ids."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: A learned model and hashed sketches decide; SQL cannot express them. tests/llm/ holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written to the shared folder and read again."""
    docs = table(apply_settings(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
