"""Connected components of a link table, as iterated joins: nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored

#: A round's labels are written as one file for so many links, and as ``FILES`` at least: small tables don't pay for a task of each shuffle partition.
LINKS, FILES = 50_000, 8


def components(edges: DataFrame, a: str = "a", b: str = "b", start: DataFrame | None = None) -> DataFrame:
    """(node, label) for each node of ``edges``; label is the smallest node of its component.

    Each round takes the least label among neighbours, for a node and for the node that is its label, and then the label of
    that label: whole components are hooked at once and paths shorten by half. Every round's labels are written, which cuts the lineage.

    ``start``: what this function gave for some of these links, from which the rounds go on.

    Defined results: links with a null end are ignored; repeated links count once; a node linked with itself alone is its own
    label; an empty table gives no rows; other columns are left out."""
    edges = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ends = F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))).alias("e")
    both = stored(edges.select(ends).select("e.u", "e.v"), "links")
    files = max(FILES, -(-both.count() // LINKS))
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label"))
    if start is not None:
        begun = start.select(F.col("node").alias("u"), F.col("label").alias("begun"))
        labels = labels.join(begun, F.col("node") == F.col("u"), "left").select("node", F.coalesce("begun", "node").alias("label"))
    labels = stored(labels.coalesce(files), "labels")
    while True:
        of_u, of_v = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "uv")
        seen = both.join(of_v, "v").join(of_u, "u").filter(F.col("label_v") < F.col("label_u"))
        near = seen.select(F.explode(F.array("u", "label_u")).alias("u"), "label_v").groupBy("u").agg(F.min("label_v").alias("near"))
        least = labels.join(near, F.col("u") == F.col("node"), "left").select("node", F.col("label").alias("old"), F.least("near", "label").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("label").alias("top"))
        following = stored(least.join(up, "mid").select("node", "old", F.least("mid", "top").alias("label")).coalesce(files), "labels")
        if following.filter(F.col("old") != F.col("label")).isEmpty():
            return following.select("node", "label")
        labels = following.select("node", "label")
