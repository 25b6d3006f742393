"""Merkle manifest of a table: one tree for each group of rows, and one over the groups' roots.

A leaf is the digest of a row. Members of a tree are numbered, so the arity of every parent follows from the tree's size
alone. A task combines the children it meets by their parent's key: a partial parent holds the digests of its children by
place, and as soon as its arity is met it becomes a child of the next parent. A subtree of ``FANOUT ** HEIGHT`` members is
handed on when its top is met; members of subtrees that a task didn't see whole are the frontier, which is shuffled by
subtree and combined again. The tops are the members of the next round, so a table of any size takes a few rounds, and no task holds
more than ``OPEN`` subtrees. Each member keeps the siblings on its way to the top: the reverse links. A proof is a member's links
followed by those of its top in the round above.

Defined results: nulls have a field of their own kind in a row's digest, so a null and an empty text differ; a null group
comes first; rows of a null order column come first in their group; rows with equal group and order are in the order of their digests, and
repeated rows are leaves of their own with equal digests, whose proofs belong to one each; a group of one row has its leaf as root; an
empty table gives no rows; further columns of the table are left out but for those asked for by ``keep``.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import numbered, stored

#: Children of a full parent, and levels of the subtrees that are combined in one task.
FANOUT, HEIGHT = 2, 8
#: Subtrees that a task keeps open at most; the one begun first goes to the frontier.
OPEN = 64


def row_digest(*fields: Column) -> Column:
    """Hex SHA-256 of the fields: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Subtree:
    """Partial parents by (level, place): the digests of the children that have come, by their places."""

    def __init__(self, size: int, fanout: int, height: int):
        self.size, self.fanout, self.height = size, fanout, height
        self.partial: dict[tuple[int, int], dict[int, str]] = {}
        self.members: list[dict] = []
        self.top: str | None = None

    def levels(self, place: int):
        """(parent's key, arity, own place) on each level from a member up to the subtree's top."""
        size = self.size
        for level in range(1, self.height + 1):
            if size == 1:
                return
            parent = place // self.fanout
            yield (level, parent), min(self.fanout, size - self.fanout * parent), place
            place, size = parent, -(-size // self.fanout)

    def add(self, member: dict) -> bool:
        """Passes the member's digest up as far as parents are complete; true if that was the top."""
        self.members.append(member)
        digest = member["digest"]
        for key, arity, place in self.levels(member["at"]):
            children = self.partial.setdefault(key, {})
            children[place] = digest
            if len(children) < arity:
                return False
            digest = _digest("".join(children[i] for i in sorted(children)))
        self.top = digest
        return True

    def links(self, place: int) -> list[str]:
        """For each level: the digests of the siblings before, a comma, and those after."""
        out = []
        for key, _, own in self.levels(place):
            children = self.partial[key]
            out.append("".join(children[i] for i in sorted(children) if i < own) + "," + "".join(children[i] for i in sorted(children) if i > own))
        return out


def _combined(members: DataFrame, fanout: int, height: int) -> DataFrame:
    """``members`` with ``path`` and ``top``, null where a task doesn't see the whole subtree."""
    schema = T.StructType([*(f for f in members.schema.fields if f.name not in ("path", "top")), T.StructField("path", T.ArrayType(T.StringType())), T.StructField("top", T.StringType())])
    names, width = schema.fieldNames(), fanout**height

    def run(batches):
        kinds, known, rows = None, {}, []
        for batch in batches:
            kinds = kinds or pa.schema([*(f for f in batch.schema if f.name not in ("path", "top")), ("path", pa.list_(pa.string())), ("top", pa.string())])
            for member in batch.to_pylist():
                key = (member["grp"], member["at"] // width)
                if (tree := known.get(key)) is None:
                    if len(known) == OPEN:
                        rows += [m | {"path": None, "top": None} for m in known.pop(next(iter(known))).members]
                    tree = known[key] = Subtree(member["n"], fanout, height)
                if tree.add(member):
                    rows += [m | {"path": tree.links(m["at"]), "top": tree.top} for m in tree.members]
                    del known[key]
            if len(rows) > 1000:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows = []
        rows += [m | {"path": None, "top": None} for tree in known.values() for m in tree.members]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return members.mapInArrow(run, schema).select(*names)


def _climb(members: DataFrame, in_order: bool, fanout: int, height: int) -> DataFrame:
    """``members`` (grp, n, at, digest and others) with ``proof``, the siblings up to their group's root, and ``root``.

    ``in_order``: the table's files hold members in their order, so that most subtrees lie in one task as they are."""
    subtree = F.floor(F.col("at") / F.lit(fanout**height)).cast("long")
    dealt = lambda df: df.repartition("grp", subtree).sortWithinPartitions("grp", "at")
    if in_order:
        first = stored(_combined(members, fanout, height), "subtrees")
        frontier = first.filter(F.col("path").isNull())
        done = first.filter(F.col("path").isNotNull()).unionByName(stored(_combined(dealt(frontier), fanout, height), "subtrees"))
    else:
        done = stored(_combined(dealt(members), fanout, height), "subtrees")
    if (members.agg(F.max("n")).first()[0] or 0) <= fanout**height:
        return done.withColumnsRenamed({"path": "proof", "top": "root"})
    tops = done.filter(F.col("at") % fanout**height == 0).select("grp", F.ceil(F.col("n") / F.lit(fanout**height)).cast("long").alias("n"), subtree.alias("at"), F.col("top").alias("digest"))
    above = _climb(tops, False, fanout, height).select(F.col("grp").alias("up_grp"), F.col("at").alias("up_at"), "proof", "root")
    joined = done.join(above, (F.col("grp") == F.col("up_grp")) & (subtree == F.col("up_at")))
    return joined.withColumn("proof", F.concat("path", "proof")).drop("path", "top", "up_grp", "up_at")


def _sized(placed: DataFrame) -> DataFrame:
    return placed.join(placed.groupBy(F.col("grp").alias("own_grp")).agg(F.count(F.lit(1)).alias("n")), F.col("grp") == F.col("own_grp")).drop("own_grp")


def manifest(df: DataFrame, fields: list[str], group: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """(``group``, ``order``, leaf, subroot, root, proof): a row for each row of ``df``, and the columns of ``keep``.

    ``proof`` has an entry for each level from the leaf over its group's root to the root: the siblings before the node, a
    comma, and those after it."""
    kept = {f"kept_{i}": c for i, c in enumerate((keep or {}).values())}
    # group as a string that is never null and sorts as it should: a null one first, others by their bytes
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = stored(df.select(grp.alias("grp"), F.col(group).alias("group_"), F.col(order).alias("order_"), row_digest(*(F.col(c) for c in fields)).alias("digest"), *(c.alias(k) for k, c in kept.items())), "leaves")
    tree = _climb(_sized(numbered(leaves, "grp", ["order_", "digest"], what="placed_leaves")), True, fanout, height)
    tree = tree.withColumnsRenamed({"proof": "below", "root": "subroot"})
    roots = stored(tree.filter(F.col("at") == 0).select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("subroot").alias("digest")), "subroots")
    over = _climb(_sized(numbered(roots, "grp", ["name"], what="placed_subroots")), True, fanout, height).select("name", "proof", "root")
    joined = tree.join(over, F.col("grp") == F.col("name"))
    return joined.select(F.col("group_").alias(group), F.col("order_").alias(order), F.col("digest").alias("leaf"), "subroot", "root", F.concat("below", "proof").alias("proof"), *(F.col(k).alias(c) for k, c in zip(kept, keep or {}, strict=True)))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.translate(F.array_join(proof, ""), ",", ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` has with the siblings of ``proof``."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(F.substring_index(s, ",", 1), node, F.substring_index(s, ",", -1)), 256))
