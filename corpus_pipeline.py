"""Documents to packed training sequences in five stages, each on all that the one before it kept.

Toxic rows and near-duplicates go row by row, whatever their ``doc_id``: rows that repeat an id
or have a null one are rows like any other. Passages of rows with a null id are not compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import mixing, packing, simhash, substring, toxicity
from fleetlens.llm.common import read
from fleetlens.llm.queries import tokenizer_path
from fleetlens.sources.scratch import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the lexicon, learned from all labels, rejects go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"), F.lit(False))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: one with the smallest doc_id."""
    return simhash.one_of_each_group(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; texts without such stay as they are."""
    cut = substring.deduplicate_passages(docs, keep_text=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to equal shares, in a random order."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: each piece of a document with its place."""
    pieces = packing.encode_pieces(docs, tokenizer_path(), value=packing.crc32_of_ids, value_type="long")
    return packing.pack(pieces).withColumnRenamed("value", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: Learned weights, fingerprints and tokenizer ids are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
