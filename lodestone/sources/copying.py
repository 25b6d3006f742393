"""Copies of related tables: in the order of their foreign keys, by upserts that can be repeated, published as one version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import versions
from lodestone.sources.stored import stored


def levels(spark: SparkSession, tables: list[str], foreign_keys: DataFrame) -> DataFrame:
    """(name, level, cyclic): tables without a parent have level 0, others one more than their highest parent.

    ``foreign_keys``: (child, parent). A table that refers to itself doesn't wait for itself. Tables on a cycle, and those that wait for
    them, come last, one level after all others, and are ``cyclic``. One join for each level."""
    names = spark.createDataFrame([(t,) for t in tables], "name string")
    links = foreign_keys.select("child", "parent").distinct().filter("child <> parent").join(names.withColumnRenamed("name", "parent"), "parent", "left_semi").join(names.withColumnRenamed("name", "child"), "child", "left_semi")
    links, open_, placed, level = stored(links, "links"), stored(names.distinct(), "open"), None, 0
    while not open_.isEmpty():
        waiting = links.join(open_.withColumnRenamed("name", "parent"), "parent", "left_semi").select(F.col("child").alias("name")).distinct()
        free = stored(open_.join(waiting, "name", "left_anti"), "free")
        cyclic = free.isEmpty()
        own = (open_ if cyclic else free).withColumns({"level": F.lit(level), "cyclic": F.lit(cyclic)})
        placed = own if placed is None else placed.unionByName(own)
        if cyclic:
            break
        open_, level = stored(open_.join(free, "name", "left_anti"), "open"), level + 1
    return placed if placed is not None else spark.createDataFrame([], "name string, level int, cyclic boolean")


def upserted(old: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of their keys; of several new rows with one key any counts. Doing it twice changes nothing."""
    new = new.dropDuplicates(key)
    if old is None:
        return new
    same = [old[k].eqNullSafe(new[k]) for k in key]
    return old.join(new, same, "left_anti").unionByName(new, allowMissingColumns=True)


def orphans(child: DataFrame, parent: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows of ``child`` whose parent is missing; ``columns`` from the child's to the parent's. A null refers to nothing."""
    keys = parent.select(*(F.col(p).alias(f"_{c}") for c, p in columns.items())).distinct()
    some = child.filter(" and ".join(f"`{c}` is not null" for c in columns))
    return some.join(keys, [F.col(c) == F.col(f"_{c}") for c in columns], "left_anti")


def copy_tables(spark: SparkSession, sources: dict[str, DataFrame], keys: dict[str, list[str]], foreign_keys: list[tuple[str, str, dict[str, str]]], path: str) -> DataFrame:
    """(name, level, cyclic, rows, orphans): what was copied to the next version of ``path``, by the levels of ``foreign_keys`` (child, parent, columns).

    Each table is the last version's with the source's rows upserted; a reader sees the new version when all tables are written, so a copy
    that stops half-way leaves the last one, and may be repeated."""
    links = spark.createDataFrame([(c, p) for c, p, _ in foreign_keys] or [], "child string, parent string")
    order = levels(spark, list(sources), links).collect()  # a row a table
    last = versions.latest(spark, path)
    done: dict[str, DataFrame] = {}
    for row in sorted(order, key=lambda r: (r.level, r.name)):
        old = last.table(spark, row.name) if last and row.name in last.names else None
        done[row.name] = stored(upserted(old, sources[row.name], keys[row.name]), f"copy_{row.name}")
    counted = None
    for row in order:
        missing = sum(orphans(done[c], done[p], by).count() for c, p, by in foreign_keys if c == row.name and p in done)
        own = done[row.name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(row.name).alias("name"), F.lit(row.level).alias("level"), F.lit(row.cyclic).alias("cyclic"), "rows", F.lit(missing).cast("long").alias("orphans"))
        counted = own if counted is None else counted.unionByName(own)
    versions.publish(spark, path, done, last)
    return counted
