"""A training-data pipeline over `documents`: each stage's rows are written as Parquet and read again by the next.

Toxic documents go, lines with an earlier copy go (and documents that had nothing else), one document of each
SimHash group stays, sources are mixed to their targets (longer documents are likelier to be drawn), and what is
left is packed into token windows, ids and all.
Nulls: a null text is kept as an empty one would be, a null doc_id is never dropped as a copy, a null source
is a source of its own. Repeated rows, ties, empty tables and further columns follow the operators' rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import line_dedup, mixing, packing, simhash, toxicity
from tallyloom.llm.common import small_batches, stash, table

#: Documents that score this or more are toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name="toxicity_").filter(F.col("toxicity_") < TOXIC).select(docs.columns)


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs).filter("not all_gone")
    counted = kept.withColumn("n_chars", F.when(F.col("lines_gone") > 0, F.char_length("text")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else kept
    return counted.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    copies = simhash.near_duplicates(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("copy_id")).distinct()
    return docs.join(copies, F.col("doc_id") == F.col("copy_id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "source", "text", F.struct(*rest).alias("row_"))
    mixed = mixing.repeated(mixing.mix(rows, importance=mixing.by_length(), keep=("text", "row_")).filter("taken > 0"))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in rest else None}
    return mixed.select(*[new.get(c, F.col(f"row_.`{c}`")).alias(c) for c in docs.columns])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.packed(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_copied_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: A learned model, XXH64 fingerprints and a tokenizer are beyond SQL; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
