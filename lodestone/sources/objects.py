"""Objects by key in any store that Spark reads: put, get, exists and delete over tables of (key, content).

An object store is a table of puts and deletions, dealt out to folders by the key's hash, so a look-up reads one folder of ``PARTS`` for each key asked for.
The last entry of a key counts. Keys are relative paths that can't leave their store.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64
ENTRY = "key string, content binary, gone boolean, at timestamp, seq string, part int"


def safe(key: Column) -> Column:
    """Whether a key stays in its store: relative, of named parts, without control characters or backslashes."""
    return F.coalesce(F.rlike(key, F.lit(r"^[^/\\\x00-\x1F]+(/[^/\\\x00-\x1F]+)*$")) & ~F.rlike(key, F.lit(r"(^|/)\.{1,2}(/|$)")) & ~F.rlike(key, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")) & (F.length(key) <= 1024), F.lit(False))


def _part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _append(df: DataFrame, path: str) -> None:
    own = df.withColumns({"at": F.current_timestamp(), "seq": F.uuid(), "part": _part(F.col("key"))})
    own.write.mode("append").partitionBy("part").parquet(path)


def put(df: DataFrame, path: str) -> DataFrame:
    """Stores the rows (key, content) of ``df`` and gives those whose key is refused. Of several rows with one key one counts; a null content is an empty one."""
    ok = safe(F.col("key"))
    _append(df.filter(ok).select("key", F.coalesce("content", F.lit(b"")).alias("content"), F.lit(False).alias("gone")), path)
    return df.filter(~ok)


def delete(keys: DataFrame, path: str) -> None:
    _append(keys.filter(safe(F.col("key"))).select("key", F.lit(None).cast("binary").alias("content"), F.lit(True).alias("gone")), path)


def entries(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(ENTRY).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(key, size): what the store holds; contents aren't read but for their length."""
    last = entries(spark, path).groupBy("key").agg(F.max_by(F.struct("gone", F.length("content").cast("long").alias("size")), F.struct("at", "seq")).alias("e"))
    return last.filter("not e.gone").select("key", "e.size")


def get(spark: SparkSession, keys: DataFrame, path: str) -> DataFrame:
    """(key, content, found) for each distinct key asked for; the content of a key that isn't there is null."""
    asked = keys.select("key").distinct().withColumn("part", _part(F.col("key")))
    own = entries(spark, path).join(asked, ["part", "key"], "left_semi")
    newest = own.groupBy("key").agg(F.max(F.struct("at", "seq")).alias("n"))
    last = own.join(newest, "key").filter((F.col("at") == F.col("n.at")) & (F.col("seq") == F.col("n.seq"))).select("key", "content", "gone")
    return asked.select("key").join(last, "key", "left").select("key", "content", F.coalesce(~F.col("gone"), F.lit(False)).alias("found"))


def exists(spark: SparkSession, keys: DataFrame, path: str) -> DataFrame:
    return get(spark, keys, path).select("key", F.col("found").alias("exists"))
