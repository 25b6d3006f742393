"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

1. Quality rules drop documents that fail the base rules or lie outside their language's perplexity band.
2. Line dedup takes boilerplate lines out of the texts; n_chars follows the text.
3. MinHash near-dedup keeps one document of each group at a similarity of 0.8 or more.
4. Benchmark decontamination drops documents in which a benchmark window occurs.
5. Byte-level BPE turns texts into token ids and checks that they decode to the text.

Defined results: a null or empty text fails the base rules of the first stage; an empty table passes through all stages; further columns
of ``documents`` pass through all stages but the last, which has its own columns; repeated rows and rows with a null id stay or go as
near_dedup states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, line_dedup, minhash_join, quality
from lodestone.llm.common import stored, table
from lodestone.llm.pretokens import read_ranks


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_join.drop_near_duplicates(docs, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, public_tokenizers.PATTERN)
    same = F.col("bytes") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A Kneser-Ney model is beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
