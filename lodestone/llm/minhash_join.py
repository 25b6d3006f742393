"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each text gives its set of word shingles and a signature of ``coords`` MinHash values. Equal sets
   collapse to one class first, so exact copies never meet in a join.
2. A pair at the threshold shares at least ``least_matches`` of its coordinates (five standard
   deviations below the mean), so in any fixed order of coordinate-value pairs it shares one of
   the first ``coords - least_matches + 1`` of each side: the prefix. The order puts values that many
   classes share last, so passages common to many texts are not posted unless a text is made of them.
3. Classes are posted under the values of their prefix. Two star rounds link the members of a posting list
   to one of them; a last round pairs, in lists of up to ``HEAVY`` members, those outside the list's largest component
   with the rest of it. Pairs that are already in one component are skipped: lists of near copies cost
   about their length, not its square, and no link between components is lost. Longer lists, if more than one
   component is left in them, are cut into blocks of at most ``BLOCK`` classes and about ``BLOCK_SHINGLES`` shingles; a task takes two
   blocks, merges their sets into a table of common shingles and gives back a spanning forest of the links, not the pairs.
4. Collisions of a pair are counted over the whole signatures; pairs with enough of them are confirmed
   on the full shingle sets of their texts, as 64-bit hashes and within a shingle of the threshold as words. Confirmed
   links give connected components.

Defined results: a null text, or one without words, has no shingles and is linked with nothing; fewer
words than a shingle make one shingle; null ids are never a component's id unless it has no other;
repeated rows are linked like copies; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import flagged, fresh, slices, stored
from lodestone.llm.components import components

WORDS = 5
#: A coordinate value shared by more classes than this goes last in the order.
HEAVY = 64
#: Classes, and shingles of them, in each of the two blocks that a task compares.
BLOCK, BLOCK_SHINGLES = 1000, 1_000_000
#: Bits of the filter that picks the texts to confirm; a full one only means more reading.
FILTER_BITS = 1 << 25
_draw = np.random.default_rng(20240101)
_MULT = _draw.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCALE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _draw.integers(0, 1 << 63, 256, dtype=np.uint64)


def least_matches(threshold: float, coords: int) -> int:
    return max(1, math.floor(coords * threshold - 5 * math.sqrt(coords * threshold * (1 - threshold))))


def text_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words; for bytes, case and white space are those of ASCII."""
    return text.lower().split() if text else []


def shingle_set(text: bytes | None) -> set[tuple[bytes, ...]]:
    w = text_words(text)
    return {tuple(w)} if 0 < len(w) < WORDS else set(zip(*(w[i:] for i in range(WORDS)), strict=False))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class _Hasher:
    """64-bit hashes of a text's distinct shingles, ascending."""

    def __init__(self):
        self.known = _Hashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        w = text_words(text)
        if not w:
            return np.zeros(0, np.uint64)
        if len(self.known) > 200_000:
            self.known = _Hashes()
        h = np.fromiter(map(self.known.__getitem__, w), np.uint64, len(w))
        n = min(WORDS, len(w))
        s = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            s += h[i : i + len(s)] * _MULT[i]
            s ^= s >> np.uint64(31)
        s *= np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(32)
        s.sort()
        return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(df: DataFrame, coords: int, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_shingles, set_key (null without shingles) and sig."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != text), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("sig", T.ArrayType(T.IntegerType()))])

    def run(batches):
        hashed, scale, shift = _Hasher(), _SCALE[:coords, None], _SHIFT[:coords, None]
        for batch in (part for whole in batches for part in slices(whole, text)):
            ns, keys, sigs = [], [], []
            for t in batch.column(text).cast(pa.binary()).to_pylist():
                s = hashed(t)
                ns.append(len(s))
                keys.append(_set_key(s) if len(s) else None)
                least = None
                for i in range(0, len(s), 4096):
                    part = ((s[None, i : i + 4096] * scale + shift) >> np.uint64(32)).min(axis=1)
                    least = part if least is None else np.minimum(least, part)
                sigs.append(None if least is None else least.astype(np.uint32).view(np.int32))
            kept = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], [*kept, "n_shingles", "set_key", "sig"])

    return df.mapInArrow(run, schema)


def _postings(classes: DataFrame, coords: int, prefix: int) -> DataFrame:
    """(value, cid, n_shingles): each class under the first ``prefix`` of its coordinate values, heavy values last."""
    value = F.transform("sig", lambda v, i: F.shiftleft(i.cast("long"), 32) + v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    heavy = classes.select(F.explode(value).alias("value")).groupBy("value").count().filter(F.col("count") > HEAVY).select(F.col("value").alias("heavy"))
    heavy = stored(heavy, "heavy")
    each = classes.repartition("cid").select("cid", "n_shingles", F.explode(value).alias("value")).join(heavy, F.col("value") == F.col("heavy"), "left")
    order = F.struct(F.col("heavy").isNotNull().alias("last"), F.col("value").alias("value"))
    first = each.groupBy("cid", "n_shingles").agg(F.slice(F.sort_array(F.collect_list(order)), 1, prefix).alias("first"))  # `coords` entries each
    return first.select("cid", "n_shingles", F.explode("first").alias("p")).select("cid", "n_shingles", "p.value")


def _forest(sets: list[np.ndarray], labels: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between sets of different labels, as many as join what they join and no more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)  # exact: set sizes are below 2^24
    for low in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(column, (low, low + 2048))
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    _, label = np.unique(labels, return_inverse=True)
    out = []
    for i in range(len(sets)):
        both = common[i, i + 1 :].astype(np.int64)
        linked = i + 1 + np.flatnonzero(100 * both >= threshold * (sizes[i] + sizes[i + 1 :] - both))
        for j in linked[label[linked] != label[i]].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _block_links(posts: DataFrame, labels: DataFrame, bodies: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between components within posting lists of more than ``HEAVY`` members.

    Lists that share classes form one group, so that their pairs are looked at once. Only classes outside a group's largest
    component are compared, with each other and with that component's: what the star rounds have linked costs nothing more."""
    listed = posts.filter(F.col("size") > HEAVY)
    chain = listed.join(listed.groupBy("value").agg(F.min("cid").alias("least")), "value").select(F.col("cid").alias("a"), F.col("least").alias("b")).distinct()
    group = components(chain).select(F.col("node").alias("cid"), F.col("label").alias("group"))
    own = group.join(labels, F.col("cid") == F.col("node"), "left").select("cid", "group", F.coalesce("label", "cid").alias("label"))
    own = stored(own.join(posts.select("cid", "n_shingles").distinct(), "cid"), "groups")
    size = own.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    parts = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    whole = size.groupBy("group").agg(F.max_by(F.struct("label", "n", "s"), F.struct("n", "label")).alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s")).filter(F.col("n") > F.col("m.n"))
    whole = whole.select("group", F.col("m.label").alias("main"), parts(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s")).alias("rest"), parts(F.col("m.n"), F.col("m.s")).alias("mains"))
    own = own.join(whole, "group").join(bodies, "cid")
    pick = F.pmod(F.xxhash64("cid"), F.when(F.col("label") == F.col("main"), F.col("mains")).otherwise(F.col("rest"))).cast("int")
    # blocks of the rest are 0 to rest - 1, those of the largest component follow; one of each two is of the rest
    own = own.withColumn("i", F.when(F.col("label") == F.col("main"), F.col("rest") + pick).otherwise(pick))
    own = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(F.col("label") == F.col("main"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("mains") - 1))))
    own = own.select("group", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "cid", "label", "body")

    def run(pdf):
        hashed, unpack = _Hasher(), zstandard.ZstdDecompressor()
        cids = pdf["cid"].to_numpy()
        found = _forest([hashed(unpack.decompress(b)) for b in pdf["body"]], pdf["label"].to_numpy(), threshold)
        return pd.DataFrame({"a": [cids[i] for i, _ in found], "b": [cids[j] for _, j in found]}, dtype="int64")

    return own.groupBy("group", "i", "j").applyInPandas(run, "a long, b long")


def _linked(pairs: DataFrame, classes: DataFrame, bodies: DataFrame, needed: int, threshold: Column | int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, in percent."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches):
        unpack, hashed, last, seen = zstandard.ZstdDecompressor(), _Hasher(), None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                if x != last:
                    last, text = x, unpack.decompress(batch.column("body_a")[i].as_py())
                    seen = hashed(text)
                body = unpack.decompress(batch.column("body_b")[i].as_py())
                other = hashed(body)
                both = len(np.intersect1d(seen, other, assume_unique=True))
                over = 100 * both - threshold * (len(seen) + len(other) - both)
                if abs(over) <= 200:  # within a shingle of the threshold the words themselves decide
                    p, q = shingle_set(text), shingle_set(body)
                    over = 100 * len(p & q) - threshold * len(p | q)
                if over >= 0:
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    own = pairs.join(bodies.select(F.col("cid").alias("b"), F.col("body").alias("body_b")), "b").join(bodies.select(F.col("cid").alias("a"), F.col("body").alias("body_a")), "a")
    return own.select("a", "b", "body_a", "body_b").mapInArrow(run, schema)


def _agreeing(pairs: DataFrame, classes: DataFrame, needed: int) -> DataFrame:
    """``pairs`` (a, b) with ``matches``, the collisions over the whole signatures, of ``needed`` or more; sizes must allow the threshold."""
    sig = lambda c: classes.select(F.col("cid").alias(c), F.col("sig").alias(f"sig_{c}"))
    both = pairs.join(sig("b"), "b").join(sig("a"), "a")
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.select("a", "b", same.alias("matches")).filter(F.col("matches") >= needed)


def _bodies(docs: DataFrame, text: str, row_id: str, wanted: DataFrame) -> DataFrame:
    """(cid, body): the compressed text of the first document of each wanted class (cid, set_key, first)."""
    slot = F.pmod(F.xxhash64(F.col("first")), F.lit(FILTER_BITS))
    mask = wanted.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS >> 6, np.int64)  # at most FILTER_BITS / 64 rows
    for r in mask:
        bits[r.w] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("body", T.BinaryType())])

    def run(batches):
        hashed, pack, words = _Hasher(), zstandard.ZstdCompressor(level=3), shared.value
        for batch in (part for whole in batches for part in slices(whole, "t")):
            at = batch.column("slot").to_numpy(zero_copy_only=False)
            may = np.flatnonzero((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
            ids, texts = batch.column("id"), batch.column("t").cast(pa.binary())
            rows = [(ids[i].as_py(), _set_key(s), pack.compress(t)) for i in may.tolist() if (t := texts[i].as_py()) and len(s := hashed(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["id", "set_key", "body"])

    own = F.col(row_id).cast("long")
    read = docs.select(own.alias("id"), F.col(text).alias("t"), F.pmod(F.xxhash64(own), F.lit(FILTER_BITS)).alias("slot")).mapInArrow(run, schema)
    found = read.join(wanted.withColumnRenamed("set_key", "key"), (F.col("set_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("first")))
    return found.groupBy("cid").agg(F.first("body").alias("body"))


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``docs`` with ``key``, the digest of each text's shingle set, as ``signatures`` gives it; null without shingles."""
    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())])

    def run(batches):
        hashed = _Hasher()
        for batch in (part for whole in batches for part in slices(whole, text)):
            sets = map(hashed, batch.column(text).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary())], [*batch.schema.names, key])

    return docs.mapInArrow(run, schema)


def _labelled(docs: DataFrame, threshold: int, text: str, row_id: str, coords: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, set_key) of each row, and (set_key, first, label) of each class of equal sets: its smallest id, and what its component's classes share."""
    needed = least_matches(threshold / 100, coords)
    signed = stored(signatures(docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text")), coords), "signatures")
    classes = signed.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    posts = _postings(classes, coords, coords - needed + 1)
    posts = posts.join(posts.groupBy("value").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1), "value")
    posts = stored(posts, "postings")
    wanted = posts.select("cid").distinct()

    links, labels, bodies, refused = None, None, None, None
    for step in ("star", "star again", "rest"):
        use = posts.filter(F.col("size") <= HEAVY) if step == "rest" else posts
        placed = use.withColumn("label", F.col("cid")) if labels is None else use.join(labels, F.col("cid") == F.col("node"), "left").select("value", "cid", F.coalesce("label", "cid").alias("label"))
        if step == "rest":
            parts = placed.groupBy("value", "label").count()
            lists = parts.groupBy("value").agg(F.count(F.lit(1)).alias("parts"), F.max_by("label", F.struct("count", "label")).alias("main")).filter(F.col("parts") > 1).select("value", "main")
            rest = placed.join(lists, "value").filter(F.col("label") != F.col("main")).select("value", F.col("cid").alias("x"), F.col("label").alias("lx"))
            pairs = rest.join(placed.select("value", F.col("cid").alias("y"), F.col("label").alias("ly")), "value").filter(F.col("lx") != F.col("ly"))
        else:
            hub = F.min_by(F.struct("cid", "label"), F.xxhash64(F.lit(step), "cid")).alias("hub")
            hubs = placed.groupBy("value").agg(hub)
            pairs = placed.join(hubs, "value").filter(F.col("label") != F.col("hub.label")).select(F.col("cid").alias("x"), F.col("hub.cid").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if refused is not None:
            pairs = pairs.join(refused, ["a", "b"], "left_anti")
        pairs = _agreeing(pairs, classes, needed)
        if step != "rest":  # one link for each class is enough here; the last round looks at all that is left
            best = lambda c: pairs.groupBy(c).agg(F.max_by(F.struct("a", "b"), F.struct("matches", "a", "b")).alias("p")).select("p.a", "p.b")
            pairs = best("b")
        pairs = stored(pairs.select("a", "b"), "pairs")
        if bodies is None:
            bodies = stored(_bodies(docs, text, row_id, classes.join(wanted, "cid", "left_semi").select("cid", "set_key", "first")), "bodies")
        good = stored(_linked(pairs, classes, bodies, needed, threshold), "links")
        bad = pairs.join(good, ["a", "b"], "left_anti")
        refused = stored(bad if refused is None else refused.unionByName(bad), "refused")
        links = good if links is None else links.unionByName(good)
        labels = components(links, start=labels)
    links = links.unionByName(stored(_block_links(posts, labels, bodies, threshold), "links"))
    labels = components(links, start=labels)
    named = classes.join(labels, F.col("cid") == F.col("node"), "left").select("set_key", "first", F.coalesce("label", "cid").alias("label"))
    return signed.drop("sig"), named


def near_duplicates(docs: DataFrame, threshold: int = 85, text: str = "text", row_id: str = "doc_id", coords: int = 64) -> DataFrame:
    """(row_id, n_shingles, set_key, component_id): one row for each row of ``docs``; ``threshold`` in percent. Ids are integers."""
    signed, named = _labelled(docs, threshold, text, row_id, coords)
    return _placed(signed, named, row_id)


def _placed(signed: DataFrame, named: DataFrame, row_id: str) -> DataFrame:
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(least, "label").select("set_key", "component_id")
    out = signed.join(named, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(row_id), "n_shingles", "set_key", own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, threshold: int = 80, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, and of rows with that id one of the least shingle set.

    Rows without shingles stay. An id that stands on one row decides for it; only rows whose id is null or stands on several rows are told
    apart by their shingle sets, which are made again for them alone. Only texts whose id may be among those that go or are unclear take part in a join."""
    signed, named = _labelled(docs, threshold, text, row_id, 64)
    gone, may, key, own = fresh(docs, "nd_id", "nd_may", "nd_key", "nd_own")
    shared = stored(signed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and id is not null").select(F.col("id").alias(own)), "shared_ids")
    dropped = _placed(signed, named, row_id).filter(F.col(row_id) != F.col("component_id")).select(F.col(row_id).alias(gone)).distinct()
    dropped = stored(dropped.join(shared, F.col(gone) == F.col(own), "left_anti"), "dropped")
    unclear = stored(dropped.select(F.col(gone).alias(own)).unionByName(shared), "doubtful")
    marked = flagged(docs, unclear, own, F.col(row_id).cast("long"), may).withColumn(may, F.col(may) | F.col(row_id).isNull())
    suspects = marked.filter(may).drop(may).join(dropped, F.col(row_id).cast("long") == F.col(gone), "left_anti")
    clear = marked.filter(~F.col(may)).drop(may)
    if shared.isEmpty() and signed.filter("id is null").isEmpty():
        return clear.unionByName(suspects)
    by_set = F.col(row_id).isNull() | F.col(own).isNotNull()
    told = suspects.join(shared, F.col(row_id).cast("long") == F.col(own), "left")
    least = named.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("last"), F.col("first").alias("id"), F.col("set_key").alias("key"))).alias("k")).select(F.col("k.id").alias(gone), F.col("k.key").alias(may))
    sets = keyed(told.filter(by_set).drop(own), text, key)
    one = sets.join(least, (F.col(key) == F.col(may)) & F.col(row_id).cast("long").eqNullSafe(F.col(gone)))
    row = F.struct(*(F.col(c) for c in docs.columns))
    one = one.groupBy(F.col(gone), F.col(may)).agg(F.first(row).alias("r")).select("r.*")  # rows of one id and one set
    empty = sets.filter(F.col(key).isNull()).select(*docs.columns)
    return clear.unionByName(told.filter(~by_set).drop(own)).unionByName(one).unionByName(empty)
