"""The ledger of processing steps: events of (document_id, step, status, at, seq) folded by a state machine, over a table or a stream.

An event that the state machine doesn't allow is flagged and changes nothing. The events of one step of one document are folded together;
they are few, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may follow on each status; "" is a step without events. A step that failed may be tried again, one that is done may be asked for anew.
FOLLOWS = {"": ["pending", "running", "skipped"], "pending": ["running", "failed", "skipped"], "running": ["completed", "failed", "skipped"], "failed": ["pending", "running"], "completed": ["pending"], "skipped": ["pending"]}
DONE = ["completed", "failed", "skipped"]
FLAGGED = "document_id string, step string, seq long, status string, at timestamp, legal boolean, now string, attempts int"


def allowed(now: Column, new: Column) -> Column:
    out = F.lit(False)
    for status, following in FOLLOWS.items():
        out = out | ((now == status) & new.isin(following))
    return F.coalesce(out, F.lit(False))


def flagged_events(events: DataFrame) -> DataFrame:
    """``FLAGGED``: each event with whether it is legal, the step's status after it and its attempts (legal starts) so far; by time, then ``seq``."""
    one = F.struct("at", "seq", F.coalesce("status", F.lit("?")).alias("status"))
    folded = events.groupBy("document_id", "step").agg(F.array_sort(F.collect_list(one)).alias("own"))
    start = F.struct(F.lit("").alias("now"), F.lit(0).alias("attempts"), F.array().cast("array<struct<seq:bigint,status:string,at:timestamp,legal:boolean,now:string,attempts:int>>").alias("out"))

    def add(state: Column, e: Column) -> Column:
        ok = allowed(state["now"], e["status"])
        now = F.when(ok, e["status"]).otherwise(state["now"])
        attempts = state["attempts"] + (ok & (e["status"] == "running")).cast("int")
        row = F.struct(e["seq"].cast("long").alias("seq"), e["status"].alias("status"), e["at"].cast("timestamp").alias("at"), ok.alias("legal"), now.alias("now"), attempts.alias("attempts"))
        return F.struct(now.alias("now"), attempts.alias("attempts"), F.concat(state["out"], F.array(row)).alias("out"))

    return folded.select("document_id", "step", F.explode(F.aggregate("own", start, add)["out"]).alias("e")).select("document_id", "step", "e.*")


def ledger(events: DataFrame) -> DataFrame:
    """(document_id, step, status, attempts, illegal, started, finished, duration_s): where each step stands; times are those of its last legal start and end."""
    flagged = flagged_events(events)
    order = F.struct("at", "seq")
    last = lambda value, cond: F.max_by(value, F.when(cond, order))
    own = flagged.groupBy("document_id", "step").agg(
        F.max_by("now", order).alias("status"), F.max("attempts").alias("attempts"), F.count_if(~F.col("legal")).alias("illegal"),
        last(F.col("at"), F.col("legal") & (F.col("status") == "running")).alias("started"), last(F.col("at"), F.col("legal") & F.col("status").isin(DONE)).alias("ended"),
    )
    finished = F.when(F.col("status").isin(DONE), F.col("ended"))
    duration = F.when(finished >= F.col("started"), F.round(finished.cast("double") - F.col("started").cast("double"), 3))
    return own.select("document_id", "step", F.nullif("status", F.lit("")).alias("status"), "attempts", "illegal", "started", finished.alias("finished"), duration.alias("duration_s"))


def document_status(steps: DataFrame) -> DataFrame:
    """(document_id, status): failed if a step is, else running, else pending, else ready."""
    has = lambda s: F.bool_or(F.coalesce(F.col("status") == s, F.lit(False)))
    return steps.groupBy("document_id").agg(F.when(has("failed"), "failed").when(has("running"), "running").when(has("pending"), "pending").otherwise("ready").alias("status"))


def follow(stream: DataFrame) -> DataFrame:
    """``flagged_events`` of a stream: each step's state (status, attempts) is kept between batches, and the events of a batch are taken in their order.

    Rows equal those of the table if no event arrives after a later one of its step was handled."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [c.split()[0] for c in FLAGGED.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempts = state.get if state.exists else ("", 0)
        rows = []
        for e in pd.concat(list(batches)).sort_values(["at", "seq"]).itertuples():
            status = e.status if isinstance(e.status, str) else "?"
            ok = status in FOLLOWS.get(now, [])
            now, attempts = (status, attempts + (status == "running")) if ok else (now, attempts)
            rows.append((*key, e.seq, status, e.at, ok, now, attempts))
        state.update((now, attempts))
        yield pd.DataFrame(rows, columns=names)

    return stream.groupBy("document_id", "step").applyInPandasWithState(run, FLAGGED, "now string, attempts int", "append", GroupStateTimeout.NoTimeout)
