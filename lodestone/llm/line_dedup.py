"""Line dedup by site-relative frequency.

A line that stands on more than ``max_ratio`` of a host's pages is boilerplate and goes from
all of that host's pages. One aggregation keyed on (host, line) with map-side combine counts
pages; the boilerplate of a host is a list of at most (its distinct lines per page) / max_ratio
hashes, whatever the host's size, and the pages themselves are filtered in place. Lines are told apart by 64-bit hashes.

Defined results: a null text stays null and counts as a page; a null host is a host of its own;
blank lines always stay; a line repeated on one page counts once; rows are never merged, so
repeated rows count as pages of their own; a page that loses all its lines keeps its row with
an empty text; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fresh, set_aside, stored


#: Arrays that a host's boilerplate is dealt out to, so that a line is looked for in one of them.
PARTS = 64


def _lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def _solid(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\f\x0b", "    ")) != ""


def boilerplate(df: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """(host, lines): the 64-bit hashes of each host's boilerplate lines, as ``PARTS`` arrays by remainder; hosts without any are left out."""
    pages = df.select(F.col(host).alias("host"), F.col(text).alias("text"))
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _solid), lambda x: F.xxhash64(x)))
    seen = pages.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = seen.filter(F.col("n") >= min_pages).alias("s").join(total.alias("t"), F.expr("s.host <=> t.host"))
    often = often.filter(F.col("n") > max_ratio * F.col("pages"))
    some = often.groupBy(F.col("s.host").alias("host"), F.pmod("line", F.lit(PARTS)).cast("int").alias("part")).agg(F.collect_list("line").alias("lines"))
    part = F.map_from_entries(F.collect_list(F.struct("part", "lines")))
    each = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.coalesce(F.element_at(F.col("lines"), i), F.array().cast("array<bigint>")))
    return some.groupBy("host").agg(part.alias("lines")).select("host", each.alias("lines"))


def drop_boilerplate(df: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.1, min_pages: int = 3, counts: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with boilerplate lines gone from ``text``; ``counts`` names columns for lines before and lines dropped, and a column of
    the caller's with such a name gets underscores at its end."""
    if counts:
        df = set_aside(df, *counts)
    h, bad, kept = fresh(df, "bp_host", "bp_lines", "bp_kept")
    # written, so that its size is known before the join: where it is small the pages aren't shuffled
    known = stored(boilerplate(df, text, host, max_ratio, min_pages).select(F.col("host").alias(h), F.col("lines").alias(bad)), "boilerplate")
    joined = df.join(known, df[host].eqNullSafe(known[h]), "left").drop(h)
    known_line = lambda x: F.array_contains(F.get(F.col(bad), F.pmod(F.xxhash64(x), F.lit(PARTS)).cast("int")), F.xxhash64(x))
    stays = F.filter(_lines(F.col(text)), lambda x: ~(_solid(x) & known_line(x)))
    joined = joined.withColumn(kept, F.when(F.col(bad).isNull(), _lines(F.col(text))).otherwise(stays))
    if counts:
        before = F.coalesce(F.size(_lines(F.col(text))), F.lit(0)).cast("long")
        joined = joined.withColumns({counts[0]: F.when(F.col(text).isNull(), 0).otherwise(before).cast("long"), counts[1]: F.when(F.col(text).isNull(), 0).otherwise(before - F.size(kept)).cast("long")})
    return joined.withColumn(text, F.array_join(kept, "\n")).drop(bad, kept)
