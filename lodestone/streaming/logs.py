"""Logs of answered queries: one stream fanned out to a table of queries and one of their strategies, each batch exactly once.

A micro-batch is written to folders of its own number, in place of what an earlier try of it left; a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunk ids and scores that a row of a strategy keeps, and characters of its query.
KEPT, MOST_QUERY = 30, 1000
STRATEGY = "array<struct<strategy:string,latency_ms:double,results:bigint,top_score:double>>"


def queries_of(answered: DataFrame) -> DataFrame:
    """A row for each query: without its lists of chunks, with their number."""
    return answered.select(
        "query_id", "question", "asked_at", "answer", "status", "confidence", F.transform("strategies", lambda s: s["strategy"]).alias("strategies"),
        F.size("chunk_ids").cast("long").alias("chunks_retrieved"), (F.col("corrective_rounds") > 0).alias("corrective_triggered"), "corrective_rounds", "latency_ms",
    )


def strategies_of(answered: DataFrame) -> DataFrame:
    """A row for each strategy that a query ran; a query without any has one of the strategy ``unknown`` with its own figures."""
    mean = F.round(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("scores"), F.lit(0)), 4)
    own = F.array(F.struct(F.lit("unknown").alias("strategy"), F.col("latency_ms").alias("latency_ms"), F.size("chunk_ids").cast("long").alias("results"), F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("top_score")))
    ran = F.when(F.size(F.coalesce("strategies", F.array().cast(STRATEGY))) > 0, F.col("strategies")).otherwise(own.cast(STRATEGY))
    rows = answered.select("query_id", F.substring("question", 1, MOST_QUERY).alias("effective_query"), F.explode(ran).alias("s"), mean.alias("mean_score"), F.slice("chunk_ids", 1, KEPT).alias("chunk_ids"), F.slice(F.transform("scores", lambda x: F.round(x, 4)), 1, KEPT).alias("scores"), (F.col("corrective_rounds") > 0).alias("was_corrective"))
    return rows.select("query_id", "s.strategy", "effective_query", "s.latency_ms", F.col("s.results").alias("results_returned"), "s.top_score", F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), "chunk_ids", "scores", "was_corrective")


TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {"queries": queries_of, "strategies": strategies_of}


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: both tables of a batch, under its number."""

    def write(batch: DataFrame, number: int) -> None:
        for name, rows in TABLES.items():
            rows(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return write


def follow(answered: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts the log of a stream of answered queries."""
    out = answered.writeStream.foreachBatch(write_batch(path)).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of ``TABLES``, with the batch of each row."""
    return spark.read.parquet(f"{path}/{name}")
