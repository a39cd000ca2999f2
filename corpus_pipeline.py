"""Corpus pipeline: quality rules, near copies, repeated passages, source mix, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame and works on all that the stage before kept. ``run`` writes each
stage's rows as Parquet to the shared checkpoint folder and reads them again for the next. All but the last
return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import mixing, ngram_join, packing, quality, superkmer
from lodestone.llm.catalog import tokenizer_path
from lodestone.llm.shared import shared_table


# Near copies: word n-grams and least Jaccard similarity in percent (op10 has its own, of its contract).
NEAR_NGRAM = 5
NEAR_PERCENT = 80


def _set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns that no operator reads under names that no operator uses, and those names."""
    names = {c: c if c in ("doc_id", "text", "source") else f"_passed{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(c).alias(n) for c, n in names.items()]), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go."""
    held, names = _set_aside(docs)
    return quality.quality_rules(held).where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of rows with similar shingles one stays, that with the smallest doc_id; repeated rows and null ids included."""
    return ngram_join.keep_one_per_component(docs, n=NEAR_NGRAM, percent=NEAR_PERCENT).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows are cut; documents of which nothing stays go."""
    held, names = _set_aside(docs)
    out = superkmer.remove_repeated_words(held)
    kept = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    kept = kept.withColumn("text", text)
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(n).alias(c) for c, n in names.items()])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of each source up to its target; what is taken twice comes twice."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences along the Hilbert curve."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("packing", pack_sequences),
]

# Token ids and component search have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
