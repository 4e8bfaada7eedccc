"""A corpus pipeline of five stages, each over all that the one before it kept.

Quality rules, line dedup, SimHash near-dedup, benchmark decontamination, best-fit
packing. Stages are joined by Parquet: ``run`` writes each stage's rows to the folder
that ``spark.checkpoint.dir`` names, reads them as the next one's documents, and
deletes the tables before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, packing, quality_rules
from tessera.llm import near_copies as copies
from tessera.llm.queries import tokenizer_path
from tessera.llm.shared import mark, read, release, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base rule nor a certified cutoff rejects."""
    labels = read(spark, sf_dir, "labels")
    cutoffs = quality_rules.calibrate(quality_rules.measured(quality_rules.labelled(docs, labels)), labels)
    return quality_rules.keep(docs, cutoffs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; n_chars is that of what stays."""
    return line_dedup.LineIndex.over(docs).rewritten(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each class of texts whose five-word
    shingles have a similarity of 0.8 or more."""
    return copies.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("best-fit packing", packed)]

#: Certified cutoffs, XXH64 fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = read(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(since, mark() - 1)  # what the stage read and wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
