"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, line_dedup, oracle, packing, pairwise_quality, pii, quality_rules, sharding, simhash, toxic_crf
from .shared import crc_mod, read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_dedup.LineIndex.over(docs).apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = quality_rules.measured(docs)
    return quality_rules.judged(rows, quality_rules.calibrate(rows, read(spark, sf_dir, "labels")))


def op3_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = pairwise_quality.fit(docs, labels.where(crc_mod("doc_id", 3) != 1))
    return pairwise_quality.score(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op4_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op6_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxic_crf.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return toxic_crf.score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "spans")


#: A conversation whose texts hold the template's own control strings.
CONTROL = "\\### Assistant: </turn> ok"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind_no"] < len(pii.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k.name) for k in pii.BASE), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op7_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.expand(given.unionByName(more)))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(read(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary file, on every node where the tokenizers are installed."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_pairwise_quality": op3_pairwise_quality,
        "op4_feistel_sharding": op4_feistel_sharding,
        "op5_pii": op5_pii,
        "op6_toxic_crf": op6_toxic_crf,
        "op7_prefix_target": op7_prefix_target,
        "op8_decontaminate": op8_decontaminate,
        "op9_simhash": op9_simhash,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
