"""Sharding by histogram sort, in shards of nearly equal bytes.

Rows are put in the order of (hash of the text, id, place in the stored table). Splitters are found
as in histogram sort: each round counts, in every partition, the exact bytes and rows between
candidate boundaries, sums the counts, and places new candidates inside the brackets whose best
boundary is still off by more than the tolerance. The driver holds a few counters for each shard, whatever the
corpus. Then rows are exchanged once, by range of (shard, key), in ranges of about ``part_bytes``, so a
task never sorts a whole shard, and a group of equal texts, however large, is cut wherever a boundary needs it. A
slot is the row's place in its range plus the rows of the shard in the ranges before, summed up from one row a range.

Each shard boundary is off by at most ``tolerance`` of a shard or half of one row's bytes.

Defined results: a null text has no bytes and counts as ``OVERHEAD``; null ids sort first; equal
rows are rows of their own; with fewer rows than shards some shards stay empty; an empty table
gives no rows; other columns pass through, and one named like a new column, in any case, is kept under its name with underscores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import fresh, set_aside, stored

#: Bytes that a row counts besides its text.
OVERHEAD = 16
_SPACE = 1 << 192


def _keys(*parts: pd.Series) -> np.ndarray:
    """Big-endian keys of 24 bytes that sort as the signed columns do."""
    key = np.empty((len(parts[0]), 3), ">u8")
    for j, p in enumerate(parts):
        key[:, j] = p.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(key).view("S24").ravel()


def _bytes(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(24, "big") for k in keys), "S24") if keys else np.array([], "S24")


def _histogram(keyed: DataFrame, columns: list[str], size: str, probes: list[int]) -> list:
    """For each interval between probes that has rows: its number, bytes, rows, least and largest key."""
    edges = _bytes(probes)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            keys = _keys(*(pdf[c] for c in columns))
            order = np.argsort(keys, kind="stable")
            keys, sizes = keys[order], np.concatenate(([0], np.cumsum(pdf[size].to_numpy(np.int64)[order])))
            cuts = np.concatenate(([0], np.searchsorted(keys, edges, "left"), [len(keys)]))
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            a, b = cuts[full], cuts[full + 1]
            pad = lambda x: [bytes(k).ljust(24, b"\0") for k in x]
            yield pd.DataFrame({"i": full, "bytes": sizes[b] - sizes[a], "rows": b - a, "lo": pad(keys[a]), "hi": pad(keys[b - 1])})

    parts = keyed.select(*columns, size).mapInPandas(run, "i long, bytes long, rows long, lo binary, hi binary")
    return parts.groupBy("i").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()


def splitters(keyed: DataFrame, columns: list[str], size: str, shards: int, tolerance: float, probes_each: int = 16) -> list[int]:
    """The least key of each shard but the first, ascending; equal ones where a shard stays empty."""
    total = keyed.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if not total:
        return []
    targets = [total * i / shards for i in range(1, shards)]
    best: list[tuple[float, int] | None] = [None] * len(targets)
    open_, probes = list(range(len(targets))), [_SPACE * j // (shards * probes_each) for j in range(1, shards * probes_each)]
    while open_:
        known = {r.i: r for r in _histogram(keyed, columns, size, probes)}  # at most a row a probe, and they follow the shards
        # cumulative bytes below each probe, then the interval of each target
        below, lower = [], 0
        for i in range(len(probes) + 1):
            got = known.get(i)
            upper = lower + (got.bytes if got else 0)
            below.append((lower, upper, got))
            lower = upper
        ends = np.array([b[1] for b in below], float)
        still, wanted = [], set()
        for s in open_:
            i = int(np.searchsorted(ends, targets[s], "left"))
            lo_bytes, hi_bytes, got = below[i]
            for key, size_below in ((probes[i - 1] if i else 0, lo_bytes), (probes[i] if i < len(probes) else _SPACE - 1, hi_bytes)):
                if best[s] is None or abs(size_below - targets[s]) < best[s][0]:
                    best[s] = (abs(size_below - targets[s]), key)
            lo, hi = int.from_bytes(got.lo, "big"), int.from_bytes(got.hi, "big")
            if best[s][0] > tolerance * total / shards and lo < hi:
                still.append(s)
                wanted.update(lo + (hi - lo) * j // probes_each for j in range(1, probes_each))
                wanted.update((lo, lo + 1, hi, hi + 1))  # the next bracket stays inside this one
        open_, probes = still, sorted(wanted)
    edges, at = [], 0
    for _, key in best:
        at = max(at, key)  # boundaries never cross
        edges.append(at)
    return edges


def shard(df: DataFrame, shards: int, text: str = "text", row_id: str = "doc_id", tolerance: float = 0.001, part_bytes: int = 64 << 20, keep_text: bool = True, **more) -> DataFrame:
    """``df`` with size (long), shard (int, from 0) and slot (long, gapless from 0 in each shard).

    ``more`` names further columns to compute while the text is at hand; ``keep_text=False`` leaves the text out
    of the exchange."""
    df = set_aside(df, "size", "shard", "slot", *more)
    h, d, pos, part, nth, base = fresh(df, "hs_hash", "hs_id", "hs_pos", "hs_part", "hs_nth", "hs_base")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")
    least = F.lit(-(1 << 63)).cast("long")
    keyed = df.withColumns({**more, "size": size, h: F.xxhash64(text), d: F.coalesce(F.col(row_id).cast("long"), least), pos: F.monotonically_increasing_id()})
    keyed = stored(keyed if keep_text else keyed.drop(text), "keyed")
    columns = [h, d, pos]
    packed = b"".join(k.to_bytes(24, "big") for k in splitters(keyed, columns, "size", shards, tolerance))  # 24 bytes a shard

    @F.pandas_udf("int")
    def place(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        edges = np.frombuffer(packed, "S24") if packed else np.array([], "S24")
        return pd.Series(np.searchsorted(edges, _keys(a, b, c), "right").astype(np.int32))

    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = max(1, -(-total // part_bytes))
    placed = keyed.withColumn("shard", place(*columns)).repartitionByRange(ranges, "shard", *columns).sortWithinPartitions("shard", *columns)
    # the upper bits of the number are those of the range
    number = F.monotonically_increasing_id()
    placed = stored(placed.withColumn(nth, number).withColumn(part, F.shiftright(nth, 33)).drop(*columns), "placed")
    begins = placed.groupBy("shard", part).agg(F.min(nth).alias(base), F.count(F.lit(1)).alias(nth))
    before = F.sum(nth).over(Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    begins = begins.select("shard", part, (F.coalesce(before, F.lit(0)) - F.col(base)).alias(base))
    return placed.join(begins, ["shard", part]).withColumn("slot", F.col(nth) + F.col(base)).drop(part, nth, base)
