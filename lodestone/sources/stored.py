"""Tables written once to the folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Tables written in the open scopes, the innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset and Spark runs in one process (tests) a folder of our own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lodestone-core-"))
    return f"file://{_own[0]}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` computed once, without its lineage: lost executors cost no recomputation of it, and Spark knows its size. The tables stay in that folder, but for those of a ``scope``."""
    path = f"{shared_dir(df.sparkSession)}/lodestone-{what}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder of any store that Spark reads; whether there was one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``stored`` inside are deleted at its end: results must have been written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)
