"""Benchmark decontamination by a prefix-filtered set join with exact containment.

An item's windows (10 consecutive words, or all words of a shorter item) are what a document
must contain. Each window is a set of word shingles with their offsets. Containment needs every
shingle, so a prefix of one shingle, the rarest in the corpus, is enough to join on:

1. one pass over the documents makes the shingles of all lengths that windows need and keeps the places of those that some window has: a
   bitmap of bounded size drops nearly all others before the join with the distinct benchmark shingles, so that little is shuffled
   where these are too many to be sent to the tasks. Places are counted by text, so copies collapse before the exchange;
2. shingles are ordered by rarity, each window takes its rarest one as prefix, and the places
   of prefixes give candidate starts, bounded by position (start >= 0) and length
   (start + window <= words of the text);
3. candidate windows are compared word by word with the text at that start; a bitmap of bounded size
   keeps texts without candidates out of the join that brings both together.

Texts are told apart by the first 128 bits of their SHA-256; step 3 reads the text itself, so no hash of a window decides.

Defined results: a null text has no words; items with a null id or without words are ignored;
repeated item rows count once; repeated documents each get their row; an empty table on either
side gives documents without hits; a column named like a new one, in any case, is kept under its name with underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ALNUM_GAP, ascii_lower, between, flagged, fresh, once, set_aside, stored


def item_words(c: Column) -> Column:
    return between(ascii_lower(c), ALNUM_GAP)


def text_key(c: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256), 1, 32))


def _shingles(ws: Column, n: Column, k: int) -> Column:
    """The hash of the k words from each start; none if there are fewer than k."""
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(k), *(F.get(ws, i + j) for j in range(k))))


def item_windows(bench: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(words, len, items): each distinct window once, with the items that have it."""
    own = bench.select(F.col(item_id).cast("string").alias("item"), once(item_words(F.col(text))).alias("w")).filter(F.col("item").isNotNull() & (F.size("w") > 0))
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window)))
    own = own.select("item", "w", start.alias("at")).select("item", F.slice("w", F.col("at") + 1, window).alias("words"))
    return own.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("words"))


def hits(docs: DataFrame, bench: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = 10, shingle: int = 5) -> DataFrame:
    """(key, n_hit, items) of each distinct text in which a window of an item occurs; items sorted."""
    wins = stored(item_windows(bench, item_id, item_text, window).withColumn("k", F.least("len", F.lit(shingle))), "windows")
    sizes = sorted(r.k for r in wins.select("k").distinct().collect())  # at most `shingle` values
    per_k = [wins.filter(F.col("k") == k).select("words", "len", F.posexplode(_shingles(F.col("words"), F.col("len"), k)).alias("off", "h")) for k in sizes]
    if not per_k:
        return docs.select(text_key(F.col(text)).alias("key"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
    grams = per_k[0]
    for more in per_k[1:]:
        grams = grams.unionByName(more)
    grams = stored(grams, "grams")
    wanted = stored(grams.select("h").distinct(), "shingles")

    base = docs.select(text_key(F.col(text)).alias("key"), once(item_words(F.col(text))).alias("w")).withColumn("n", F.size("w"))
    each = [F.transform(_shingles(F.col("w"), F.col("n"), k), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for k in sizes]
    places = base.select("key", "n", F.explode(each[0] if len(each) == 1 else F.concat(*each)).alias("p")).select("key", "n", "p.pos", "p.h")
    places = flagged(places, wanted, "h", F.col("h"), "may").filter("may").drop("may").join(wanted, "h")
    places = stored(places.groupBy("key", "n", "pos", "h").agg(F.count(F.lit(1)).alias("copies")), "places")

    rarity = places.groupBy("h").agg(F.sum("copies").alias("freq"))
    ranked = grams.join(rarity, "h", "left").groupBy("words", "len").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "h", "off")).alias("least"))
    # written: small against the places, and if it is too large to be sent to them, Spark splits the places of a frequent shingle
    prefix = stored(ranked.filter(F.col("least.freq") > 0).select("words", "len", F.col("least.h").alias("h"), F.col("least.off").alias("off")), "prefix")
    start = F.col("pos") - F.col("off")
    found = places.join(prefix, "h").select("key", "n", start.alias("start"), "len", "words").filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    # a text has at most one window of each length at each start
    cands = stored(found.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "len", "words"))).alias("cands")), "candidates")

    texts = flagged(docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("t")), cands, "key", F.col("key"), "may").filter("may").drop("may").join(cands, "key")
    texts = texts.select("key", once(item_words(F.col("t"))).alias("w"), "cands")
    right = F.filter("cands", lambda c: F.slice(F.col("w"), c["start"] + 1, c["len"]) == c["words"])
    texts = texts.select("key", right.alias("hit")).filter(F.size("hit") > 0)
    end = lambda c: c["start"] + c["len"]
    covered = F.aggregate(
        "hit",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, c: F.struct((a["n"] + F.greatest(F.lit(0), end(c) - F.greatest(c["start"], a["end"]))).alias("n"), F.greatest(end(c), a["end"]).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    texts = stored(texts.select("key", covered.alias("n_hit"), F.array_distinct(F.transform("hit", lambda c: c["words"])).alias("wins")).dropDuplicates(["key"]), "hits")
    named = texts.select("key", F.explode("wins").alias("words")).join(wins.select("words", "items"), "words")
    named = named.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return texts.select("key", "n_hit").join(named, "key")


def report(docs: DataFrame, bench: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without its text, with n_words, n_hit, items (sorted ids); one row for each row of ``docs``."""
    found = hits(docs, bench, text, **how)
    docs = set_aside(docs.withColumnRenamed(text, fresh(docs, "dc_text")[0]), "n_words", "n_hit", "items")
    own_text, key, other = next(c for c in docs.columns if c.startswith("dc_text")), *fresh(docs, "dc_key", "dc_other")
    own = docs.withColumns({"n_words": F.size(item_words(F.col(own_text))).cast("long"), key: text_key(F.col(own_text))}).drop(own_text)
    joined = own.join(found.withColumnRenamed("key", other), F.col(key) == F.col(other), "left").drop(key, other)
    return joined.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def drop_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; only texts that may be among them take part in the join."""
    key, other, may = fresh(docs, "dc_key", "dc_other", "dc_may")
    found = stored(hits(docs, bench, text, **how).select(F.col("key").alias(other)), "contaminated")
    marked = flagged(docs.withColumn(key, text_key(F.col(text))), found, other, F.col(key), may)
    suspects = marked.filter(may).join(found, F.col(key) == F.col(other), "left_anti")
    return marked.filter(~F.col(may)).unionByName(suspects).drop(key, may)
