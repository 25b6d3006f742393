"""The experiment protocol: several strategies over one set of questions, labels made once from all they found, metrics against these labels alone.

A. Every strategy answers every question at ``k``. B. Questions without labels of their own get them from a judge, who sees the pooled results
of all strategies once and not which strategy found what. C. Each strategy's results are measured against the same labels, so that none is
judged by labels that only its own results could give.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import judge as J
from lodestone.operators import metrics as M
from lodestone.plans import strategies as S
from lodestone.sources.stored import stored


@dataclass(frozen=True)
class Experiment:
    """results (strategy, query_id, chunk_id, score, rank), labels (query_id, chunk_id, relevant), per_question and summary by strategy."""

    results: DataFrame
    labels: DataFrame
    per_question: DataFrame
    summary: DataFrame


def run(questions: DataFrame, corpus: S.Corpus, strategies: list[str], judge: J.Hook | None = None, labels: DataFrame | None = None, k: int = 8, config: S.Config | None = None) -> Experiment:
    """``questions``: (query_id, query[, category]); ``labels``: (query_id, chunk_id) of questions that have their own. A question without any label has null metrics."""
    config = config or S.Config(top_k=k)
    results = None
    for name in strategies:
        own = S.REGISTRY_ALL[name](questions.select("query_id", "query"), corpus, config).filter(F.col("rank") <= k).select(F.lit(name).alias("strategy"), "query_id", "chunk_id", "score", "rank")
        results = own if results is None else results.unionByName(own)
    results = stored(results, "results")
    known = questions.select("query_id").limit(0).withColumns({"chunk_id": F.lit(None).cast(results.schema["chunk_id"].dataType), "relevant": F.lit(True)}) if labels is None else labels.select("query_id", "chunk_id", F.lit(True).alias("relevant"))
    if judge is not None:
        open_ = questions.join(known.select("query_id").distinct(), "query_id", "left_anti")
        pooled = results.join(open_.select("query_id"), "query_id", "left_semi").join(corpus.chunks.select("chunk_id", "content"), "chunk_id")
        known = known.unionByName(J.judge_pool(open_, pooled, judge, max(k, 10)))
    known = stored(known, "labels")
    per = measured(results, known, k)
    if "category" in questions.columns:
        per = per.join(questions.select("query_id", "category"), "query_id")
    return Experiment(results, known, per, summarised(per, results, questions))


def measured(results: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Ranking metrics of each strategy and question, and whether the question has labels; all strategies in one pass."""
    gains = labels.filter("relevant").select(F.col("query_id").alias("q"), F.col("chunk_id").alias("item"), F.lit(1.0).alias("gain")).distinct()
    names = results.select("strategy").distinct()
    each = F.struct("strategy", "query_id").alias("query_id")
    own = results.select(each, F.col("chunk_id").alias("item"), "rank")
    by = gains.join(names).select(F.struct("strategy", F.col("q").alias("query_id")).alias("query_id"), "item", "gain")  # labels times strategies
    per = M.ranking_metrics(own, by, k)
    return per.select("query_id.strategy", "query_id.query_id", *(c for c in per.columns if c != "query_id"), F.col("recall").isNotNull().alias("labelled"))


def summarised(per: DataFrame, results: DataFrame, questions: DataFrame) -> DataFrame:
    """(strategy, means, queries, answered, labelled, asked, place): means over questions with labels; places by nDCG, then recall, then name."""
    n = questions.agg(F.count(F.lit(1)).alias("asked"))  # one row
    means = M.mean_metrics(per, ["strategy"]).drop("queries")
    counts = per.groupBy("strategy").agg(F.count(F.lit(1)).alias("answered"), F.count_if("labelled").alias("labelled"))
    both = results.groupBy("strategy").agg(F.round(F.avg("score"), 6).alias("mean_score")).join(means, "strategy").join(counts, "strategy").crossJoin(F.broadcast(n))
    place = F.row_number().over(Window.orderBy(F.col("ndcg").desc_nulls_last(), F.col("recall").desc_nulls_last(), "strategy"))  # a row a strategy
    return both.withColumn("place", place)
