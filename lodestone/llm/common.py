"""What the training-data operators share: reading, column helpers and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of letters and digits, in lower case; every code point from U+0080 counts as a letter.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between them.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

_fallback: list[str] = []
#: Rows of an Arrow batch at most while a table is written: batches of long texts take memory of the executor and of its workers.
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset and Spark is local (tests) a folder of our own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="lodestone-"))
    return f"file://{_fallback[0]}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    This cuts the lineage: a lost executor costs no recomputation of what stands before,
    and Spark knows the table's size when it chooses join strategies.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """``batch`` in slices of about ``most`` bytes of ``column``, so that a worker's memory follows bytes, not rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    groups = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def flagged(df: DataFrame, keys: DataFrame, key: str, value: Column, flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: true for every row whose ``value`` is among the ``key`` of ``keys``, and for few others.

    The keys become a bitmap of 16 bits for each, at most 2^26, so a million rows of 64 bits at most are sent to the tasks; a
    full one only lets more rows through to the join that decides. ``keys`` must be a written table, as it is counted."""
    slots = 1 << max(12, min(26, (16 * keys.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    at, word, bits = fresh(df, "fl_at", "fl_word", "fl_bits")
    set_ = keys.select(slot(F.col(key)).alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({at} & 63 as int))")).alias(bits))
    joined = df.withColumn(at, slot(value)).join(F.broadcast(set_), F.shiftright(at, 6) == F.col(word), "left")
    return joined.withColumn(flag, F.coalesce(F.getbit(bits, F.expr(f"cast({at} & 63 as int)")) == 1, F.lit(False))).drop(at, word, bits)


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its columns that have one of ``names``, in any case, renamed by underscores at their end: new columns don't replace them."""
    wanted = {n.lower() for n in names}
    for c in [c for c in df.columns if c.lower() in wanted]:
        taken, new = {x.lower() for x in df.columns} | wanted, c
        while new.lower() in taken:
            new += "_"
        df = df.withColumnRenamed(c, new)
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have yet, compared as Spark does, ignoring case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def between(c: Column, gap: str) -> Column:
    """The words between matches of ``gap``; none for null. Java splits about twice as fast as it extracts."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), gap, -1), "")


def once(c: Column) -> Column:
    """``c`` as a generator of one row. Catalyst copies a projected expression into each lambda that
    uses it, to be evaluated for each element; a generator's output is computed once."""
    return F.explode(F.array(c))


def numbered(df: DataFrame, group: str, order: list[str], sums: tuple[str, ...] = (), what: str = "numbered") -> DataFrame:
    """``df`` with ``at``, each row's place from 0 among those of its ``group`` by ``order``, and ``<s>_before`` for each of ``sums``: the sum of that column over the rows before.

    Rows are cut into ranges of (group, order), so a group of any size is dealt out to many tasks. Each task counts its own ranges;
    only groups that a cut divides need what stands before, and these are at most two for each task: their offsets are broadcast.
    ``df`` must be a written table, as the cuts are drawn from it; ``group`` must not be null. Rows that tie keep an order of no meaning."""
    salt, part = fresh(df, "nb_salt", "nb_part")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, salt]
    ranged = df.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(salt)
    before = [f"{s}_before" for s in sums]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in (part, "at", *before))])

    def run(batches):
        from pyspark import TaskContext

        own, last, carry = TaskContext.get().partitionId(), None, np.zeros(1 + len(sums), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keyed = batch.column(group)
            first = np.concatenate(([last is None or keyed[0].as_py() != last], pc.not_equal(keyed[1:], keyed[:-1]).to_numpy(zero_copy_only=False)))
            starts = np.flatnonzero(first)
            out = []
            for i, v in enumerate([np.ones(batch.num_rows, np.int64), *(batch.column(s).to_numpy(zero_copy_only=False).astype(np.int64) for s in sums)]):
                total = np.concatenate(([0], np.cumsum(v)))
                base = np.zeros(batch.num_rows, np.int64) - carry[i]
                base[starts] = total[starts]
                base = base[np.maximum.accumulate(np.where(first, np.arange(batch.num_rows), 0))] if len(starts) else base
                out.append(total[:-1] - base)
                carry[i] = total[-1] - base[-1]
            last = keyed[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, own)), *map(pa.array, out)], [*batch.schema.names, part, "at", *before])

    placed = stored(ranged.mapInArrow(run, schema), what)
    ends = placed.groupBy(group, part).agg(F.count(F.lit(1)).alias("at"), *(F.sum(s).alias(b) for s, b in zip(sums, before, strict=True)))
    cut = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(group, part, *(F.coalesce(F.sum(c).over(cut), F.lit(0)).alias(f"{c}_off") for c in ("at", *before))).filter(F.col("at_off") > 0)
    joined = placed.join(F.broadcast(offsets), [group, part], "left")
    return joined.select(*df.columns, *((F.col(c) + F.coalesce(F.col(f"{c}_off"), F.lit(0))).alias(c) for c in ("at", *before)))
