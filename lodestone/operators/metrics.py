"""Evaluation metrics and dashboards: aggregations over results, labels and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _round(c, n=6):
    return F.round(c, n)


def ranking_metrics(results: DataFrame, labels: DataFrame, k: int = 8) -> DataFrame:
    """Recall, precision, reciprocal rank, nDCG and hit of each query; null without labels. ``results``: (query_id, item, rank); ``labels``: (query_id, item, gain),
    or (item, gain) where they hold for every query; the ideal is then computed once.

    Precision divides by the results returned, up to k; the reciprocal rank looks at the whole list."""
    each = "query_id" in labels.columns
    joined = results.join(labels, ["query_id", "item"] if each else ["item"], "left")
    top = F.col("rank") <= k
    good = F.col("gain") > 0
    per = joined.groupBy("query_id").agg(F.count_if(top & good).alias("hits"), F.count_if(top).alias("returned"), F.min(F.when(good, F.col("rank"))).alias("first"), F.sum(F.when(top & good, F.col("gain") / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    if each:
        own = labels.filter(good).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "item")))
        ideal = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("r") <= k, F.col("gain") / F.log2(F.col("r") + 1.0))).alias("idcg"))
        d = per.join(ideal, "query_id", "left")
    else:
        relevant = labels.filter(good).agg(F.nullif(F.count(F.lit(1)), F.lit(0)).alias("relevant"))
        best = labels.filter(good).orderBy(F.col("gain").desc(), "item").limit(k).agg(F.sort_array(F.collect_list("gain"), asc=False).alias("g"))  # k gains
        idcg = F.aggregate(F.transform("g", lambda x, i: x / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
        d = per.crossJoin(F.broadcast(relevant.crossJoin(best.select(idcg.alias("idcg")))))
    known = F.col("relevant").isNotNull()
    return d.select(
        "query_id",
        _round(F.when(known, F.col("hits") / F.col("relevant"))).alias("recall"),
        _round(F.when(known, F.coalesce(F.try_divide("hits", "returned"), F.lit(0.0)))).alias("precision"),
        _round(F.when(known, F.coalesce(1 / F.col("first"), F.lit(0.0)))).alias("reciprocal_rank"),
        _round(F.when(known, F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("idcg"))).alias("ndcg"),
        F.when(known, (F.col("hits") > 0).cast("double")).alias("hit"),
    )


def mean_metrics(per_query: DataFrame, by: list[str]) -> DataFrame:
    """Means that skip nulls."""
    return per_query.groupBy(*by).agg(*(_round(F.avg(c)).alias(c) for c in ("recall", "precision", "reciprocal_rank", "ndcg", "hit")), F.count(F.lit(1)).alias("queries"))


def pool(results: DataFrame, depth: int = 10) -> DataFrame:
    """The distinct union of every strategy's first ``depth`` items for each query."""
    return results.filter(F.col("rank") <= depth).select("query_id", "item").distinct()


def groundedness(judged: DataFrame) -> DataFrame:
    """Share of supported claims of each answer; a partly supported one counts half."""
    value = F.when(F.col("verdict") == "supported", 1.0).when(F.col("verdict") == "partially_supported", 0.5).otherwise(0.0)
    return judged.groupBy("answer_id").agg(_round(F.avg(value), 4).alias("groundedness"))


def system_metrics(log: DataFrame, by: list[str], latency: str = "latency_ms") -> DataFrame:
    """Mean, median, 95th percentile (linear interpolation), extremes, sums and rates."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"), _round(F.avg(latency)).alias("mean_ms"), _round(F.percentile(latency, 0.5)).alias("median_ms"), _round(F.percentile(latency, 0.95)).alias("p95_ms"),
        _round(F.min(latency)).alias("min_ms"), _round(F.max(latency)).alias("max_ms"), F.sum("tokens").cast("long").alias("tokens"), _round(F.sum("cost")).alias("cost"),
        _round(F.avg(F.col("corrective").cast("double"))).alias("corrective_rate"), _round(F.avg(F.col("abstained").cast("double"))).alias("abstention_rate"),
    )


def strategy_summary(log: DataFrame) -> DataFrame:
    """One row for each strategy and one for each (strategy, category), in one pass."""
    return log.groupingSets([["strategy"], ["strategy", "category"]], "strategy", "category").agg(
        F.coalesce("category", F.lit("all")).alias("part"), F.count(F.lit(1)).alias("questions"), _round(F.avg("latency_ms")).alias("mean_ms"),
        _round(F.avg(F.when(F.col("expects_abstention"), F.col("abstained").cast("double")))).alias("abstention_correct"),
    )


def strategy_usage(log: DataFrame, strategies: str = "strategies") -> DataFrame:
    return log.select(F.explode(strategies).alias("strategy")).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest completed run of each strategy."""
    own = runs.filter(F.col("status") == "completed")
    latest = own.groupBy("strategy").agg(F.max_by(F.struct(*own.columns), F.struct("created_at", "run_id")).alias("r"))  # combined before the exchange
    return latest.select("r.*")


def best_per_metric(runs: DataFrame, metrics: list[str], lower_is_better: list[str]) -> DataFrame:
    """(metric, strategy, value): the best strategy of each metric, the least value where lower is better."""
    long = runs.unpivot(["strategy"], metrics, "metric", "value").filter(F.col("value").isNotNull())
    signed = F.when(F.col("metric").isin(lower_is_better), F.col("value")).otherwise(-F.col("value"))
    return long.groupBy("metric").agg(F.min_by(F.struct("strategy", "value"), F.struct(signed, "strategy")).alias("b")).select("metric", "b.strategy", "b.value")


# -- dashboards over the query log


def totals(log: DataFrame, now) -> DataFrame:
    """Counts, means, sums and guarded rates of the whole log; 0 where it is empty."""
    n = F.count(F.lit(1))
    return log.agg(
        n.alias("queries"), F.coalesce(_round(F.avg("latency_ms")), F.lit(0.0)).alias("mean_ms"), F.coalesce(_round(F.avg("confidence")), F.lit(0.0)).alias("mean_confidence"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(_round(F.sum("cost")), F.lit(0.0)).alias("cost"), F.count_if(F.col("created_at") >= now - F.expr("INTERVAL 7 DAYS")).alias("last_7_days"), F.count_if("corrective").alias("corrective"), F.count_if("abstained").alias("abstained"),
        F.coalesce(_round(F.try_divide(F.count_if("corrective"), n), 4), F.lit(0.0)).alias("corrective_rate"), F.coalesce(_round(F.try_divide(F.count_if("abstained"), n), 4), F.lit(0.0)).alias("abstention_rate"),
    )


def distribution(log: DataFrame, column: str, top: int = 12) -> DataFrame:
    """The most frequent values with their percentage of all values. The window runs over one row for each distinct value."""
    counts = log.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent")).orderBy(F.col("n").desc(), "value").limit(top)


#: Lower and upper bounds of the confidence histogram, the last one closed.
BUCKETS = [(0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.01)]


def confidence_histogram(log: DataFrame, column: str = "confidence") -> DataFrame:
    """Rows in each of five half-open buckets, empty ones too."""
    c = F.col(column)
    bucket = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(BUCKETS):
        bucket = F.when((c >= lo) & (c < hi), i).otherwise(bucket)
    names = log.sparkSession.createDataFrame([(i, f"{lo:.1f}-{min(hi, 1.0):.1f}") for i, (lo, hi) in enumerate(BUCKETS)], "bucket int, label string")
    counts = log.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "bucket", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def daily(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), _round(F.avg("latency_ms")).alias("mean_ms"))


def recent(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(F.col("created_at").desc(), "query_id").limit(n)


def page(rows: DataFrame, order: list, limit: int, offset: int = 0, equal: dict | None = None, search: str | None = None, in_columns: tuple[str, ...] = ()) -> DataFrame:
    """A filtered, ordered page with the number of all matches in ``total``."""
    own = rows
    for c, v in (equal or {}).items():
        own = own.filter(F.col(c) == v)
    if search:
        like = F.lit(False)
        for c in in_columns:
            like = like | F.col(c).ilike(f"%{search}%")
        own = own.filter(like)
    total = own.agg(F.count(F.lit(1)).alias("total"))
    return own.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def knowledge_base_stats(documents: DataFrame, chunks: DataFrame, entities: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """(kind, name, n): sums over all documents, and histograms by status, file type and modality.

    ``documents`` needs status, file_type, chunk_count, token_count, page_count, table_count, figure_count and size_bytes."""
    sums = {"documents": F.count(F.lit(1)), **{c: F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in ("chunk_count", "token_count", "page_count", "table_count", "figure_count", "size_bytes")}}
    one = documents.agg(*(v.alias(k) for k, v in sums.items()))
    out = one.unpivot([], list(sums), "name", "n").select(F.lit("total").alias("kind"), "name", "n")
    for kind, df, column in (("status", documents, "status"), ("type", documents, "file_type"), ("modality", chunks, "modality")):
        out = out.unionByName(df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n"))
    for name, df in (("entities", entities), ("relations", relations)):
        if df is not None:
            out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n"))
    return out


def most_used(log: DataFrame, column: str = "strategy") -> DataFrame:
    """(value, n): the most frequent value of the log, the least of several; no row where it is empty."""
    counts = log.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "value").limit(1)


def conversation_list(turns: DataFrame, limit: int = 50) -> DataFrame:
    """(conv_id, turns, last_turn): conversations with the most recent last turn first."""
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last_turn"))
    return own.orderBy(F.col("last_turn").desc(), "conv_id").limit(limit)


def conversation_history(turns: DataFrame, most: int = 6) -> DataFrame:
    """The last turns of each conversation, oldest first."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    own = turns.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= most)
    return own.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("back")


def trace_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy("name").agg(F.count(F.lit(1)).alias("spans"), _round(F.sum("ms")).alias("ms"), F.sum("tokens").cast("long").alias("tokens"))


def llm_cost(tokens_in, tokens_out, price_in: float, price_out: float):
    """Tokens over a million times the price."""
    return F.round(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 9)
