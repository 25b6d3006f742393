"""Sets of tables in versions: written whole, published by one marker, read at one version, removed after a grace period.

``path/tables/<version>/<name>`` holds a version's tables and ``path/published/n=<number>`` a row that names it. The row is written after the
tables and never changed, so a reader sees all tables of a version or none of it; a reader that has one keeps it until it is removed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.stored import remove

ROW = "number long, version string, names array<string>, at timestamp"


@dataclass(frozen=True)
class Version:
    """The tables of one version."""

    path: str
    number: int
    version: str
    names: tuple[str, ...]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        return spark.read.parquet(f"{self.path}/tables/{self.version}/{name}")


def history(spark: SparkSession, path: str) -> DataFrame:
    """``ROW`` of all published versions; none where nothing was published."""
    try:
        return spark.read.schema(ROW).option("recursiveFileLookup", "true").parquet(f"{path}/published")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ROW)


def latest(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The last published version, or the one of ``number``."""
    rows = history(spark, path)
    row = (rows.filter(F.col("number") == number) if number is not None else rows).orderBy(F.col("number").desc(), "version").first()
    return None if row is None else Version(path, row.number, row.version, tuple(row.names))


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], base: Version | None = None) -> Version:
    """A new version of ``tables``. With ``base`` it is refused if another version was published since: the marker of its number exists."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/tables/{version}/{name}")
    if base is None:
        known = latest(spark, path)
        number = known.number + 1 if known else 1
    else:
        number = base.number + 1
    row = spark.createDataFrame([(number, version, list(tables))], "number long, version string, names array<string>").withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("errorifexists").parquet(f"{path}/published/n={number:012d}")
    return Version(path, number, version, tuple(tables))


def expire(spark: SparkSession, path: str, keep: int = 2, grace_seconds: int = 3600) -> list[int]:
    """Removes the tables and markers of versions that are older than the last ``keep`` and than the grace period; their numbers."""
    rows = history(spark, path).withColumn("age", F.current_timestamp().cast("double") - F.col("at").cast("double")).orderBy(F.col("number").desc()).collect()  # a row a version
    old = [r for r in rows[keep:] if r.age >= grace_seconds]
    for r in old:  # the marker first: no new reader finds a version whose tables go
        remove(spark, f"{path}/published/n={r.number:012d}")
        remove(spark, f"{path}/tables/{r.version}")
    return sorted(r.number for r in old)
