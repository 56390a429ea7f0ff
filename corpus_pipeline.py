"""Corpus cleaning as five stages: toxic documents go, near duplicates go but for one of each
group, documents that leak a benchmark item go, secrets are blotted out, and what is left is
mixed to the sources' target weights.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame
that the next one gets as docs, written as Parquet and read again. All but the last return
the columns of docs. Defined results are those of the operators; in the mix, rows of one
doc_id and size are taken alike, and documents of which no word is taken are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lantern.llm import decontaminate, jaccard, mixing, secrets, toxicity
from lantern.llm.batches import counted
from lantern.session import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a model of the labelled documents among docs."""
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates: chains of
    five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    return jaccard.deduplicate(docs, n=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by [SECRET]."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the words they count for (size) and are taken for (taken,
    repeats counted), and their source's words (source_size) and target; columns of docs with
    one of these names give way."""
    got = mixing.mix(docs).groupBy("doc_id", "size").agg(F.max("taken").alias("taken"), F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    got = counted(written(got.filter("taken > 0"), "taken"))
    # Joined as structs of names of their own: docs may have columns of any name.
    own, mix = docs.select(F.struct(*docs.columns).alias("_row"), mixing.words(F.col("text")).alias("_size")), got.select(F.struct(*got.columns).alias("_mix"))
    both = own.join(mix, F.col("_row.doc_id").eqNullSafe(F.col("_mix.doc_id")) & (F.col("_size") == F.col("_mix.size")))
    added = ["size", "source_size", "target", "taken"]
    return both.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in added), *(F.col("_mix")[c].alias(c) for c in added))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("secret_scans", secrets_stage),
    ("mixing_to_weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model and a redaction by character class are no SQL; the tests hold each stage
#: against brute force.
ORACLE_SQL = None
