"""From raw documents to a mixed training set: five stages, each written as Parquet and read by the next.

Toxic documents go; runs of lines that stood earlier go; one document of each group of near copies stays;
documents with benchmark passages go; the rest is mixed to the target weights of its sources, where a
document that the mix does not take goes and the others say how many words of them are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.decontamination import drop_contaminated
from lotwise.llm.lines import COMMON_WORDS, OFTEN, WORDS, deduplicate_lines
from lotwise.llm.mixing import mix_sources
from lotwise.llm.shelter import free_name
from lotwise.llm.simhash import drop_near_copies
from lotwise.llm.text import training_part, word_count
from lotwise.llm.toxicity import drop_toxic, fit_toxicity
from lotwise.session import via_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the training part and drops what it predicts to be toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit_toxicity(docs.where(training_part(F.col("doc_id"))), labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated runs of lines out of the texts: of three lines, of one or two with enough words, and single lines
    that stand in very many documents; ``n_chars`` follows the text."""
    cut = deduplicate_lines(docs, words=WORDS, common_words=COMMON_WORDS, often=OFTEN)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three-word shingles, at most two differing bits; the smallest id of a group stays."""
    return drop_near_copies(docs, shingle=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which ten words in a row of a benchmark item (or a whole shorter item) occur."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted)."""
    added = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c not in added]
    out = free_name(docs.columns, "mix")
    mixed = mix_sources(docs.select(*kept), word_count(F.col("text")), key=["doc_id", "n_chars"], out=out)
    return mixed.select(*kept, *[F.col(out)[c].alias(c) for c in added]).where(F.col("taken") > 0)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# Learned scores and 64-bit shingle hashes are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = via_table(stage(spark, docs, sf_dir), name)
    return docs
