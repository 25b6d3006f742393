"""Traces: spans (trace_id, span_id, parent_id, start, end) as trees: own time, depth and the critical path of all traces at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.stored import stored


def self_times(spans: DataFrame) -> DataFrame:
    """``spans`` with duration, children and self_time: the part of a span that none of its children covers.

    Children may overlap and reach beyond their parent: their intervals are clipped to it, and their union is what reaches beyond the furthest end before."""
    ends = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("start").alias("p0"), F.col("end").alias("p1"))
    child = spans.join(ends, ["trace_id", "parent_id"]).withColumns({"c0": F.greatest("start", "p0"), "c1": F.least("end", "p1")})
    w = Window.partitionBy("trace_id", "parent_id").orderBy("c0", "c1", "span_id").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0.0), F.col("c1") - F.greatest("c0", F.coalesce(F.max("c1").over(w), F.col("c0"))))
    covered = child.withColumn("new", new).groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("new").alias("covered"), F.count(F.lit(1)).alias("children"))
    both = spans.join(covered, ["trace_id", "span_id"], "left")
    duration = F.col("end") - F.col("start")
    return both.withColumns({"duration": duration, "children": F.coalesce("children", F.lit(0)), "self_time": F.greatest(F.lit(0.0), duration - F.coalesce("covered", F.lit(0.0)))}).drop("covered")


def critical_paths(spans: DataFrame, most: int = 64) -> DataFrame:
    """(trace_id, span_id, depth): from each root, the child that ends last, and so on; of several the one that starts last, then the smallest id.

    One join a level, over the spans on the paths only; ``most`` levels at most. A span whose parent is missing is a root."""
    ids = spans.select("trace_id", F.col("span_id").alias("parent_id"))
    roots = spans.filter("parent_id is null").unionByName(spans.filter("parent_id is not null").join(ids, ["trace_id", "parent_id"], "left_anti").select(*spans.columns))
    last = F.row_number().over(Window.partitionBy("trace_id", "parent_id").orderBy(F.col("end").desc(), F.col("start").desc(), "span_id"))
    heirs = stored(spans.filter("parent_id is not null").withColumn("n", last).filter("n = 1").select("trace_id", F.col("parent_id").alias("of"), F.col("span_id").alias("heir")), "heirs")
    level = stored(roots.select("trace_id", "span_id", F.lit(0).alias("depth")), "critical")
    out = level
    for depth in range(1, most + 1):
        below = level.join(heirs, (level["trace_id"] == heirs["trace_id"]) & (F.col("span_id") == F.col("of"))).select(level["trace_id"], F.col("heir").alias("span_id"), F.lit(depth).alias("depth"))
        level = stored(below, "critical")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def summary(spans: DataFrame) -> DataFrame:
    """(trace_id, spans, elapsed, busy, critical, slowest): how long a trace took, the sum of own times, the length of its critical path and its span with the most own time."""
    own = self_times(spans)
    path = critical_paths(spans).groupBy("trace_id").agg(F.count(F.lit(1)).alias("critical"))
    total = own.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"), (F.max("end") - F.min("start")).alias("elapsed"), F.sum("self_time").alias("busy"), F.min_by("span_id", F.struct(-F.col("self_time"), F.col("span_id"))).alias("slowest"))
    return total.join(path, "trace_id")
