"""Chunks and entities from blocks."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import lexicons as L
from lodestone.functions import text as X
from lodestone.sources.parsers import tidy

# Kinds of block that are chunks of their own, and by how much a chunk may exceed its target.
ATOMIC = ["table", "figure", "image", "code"]
CEILING = 2.2
_gap = re.compile(L.SENTENCE_GAP)


def tokens_of(text: str) -> int:
    return max(1, len(text) // 4, len(text.split()) // 2) if text else 0


def ranges(sizes: list[int], limit: int, carry: int) -> list[tuple[int, int]]:
    """Ranges of consecutive units of at most ``limit`` in all, a single unit being free to exceed it; each but the first
    begins with the units at the end of the one before that fit into ``carry``."""
    sums, out, start, end = [0, *accumulate(sizes)], [], 0, 0
    while end < len(sizes):
        stop = max(end + 1, bisect_right(sums, sums[start] + limit) - 1)
        out.append((start, stop))
        start, end = max(start, bisect_left(sums, sums[stop] - carry)) if carry else stop, stop
    return out


def cut_prose(text: str, target: int, overlap: int) -> list[str]:
    """A text as overlapping runs of its sentences."""
    units = [u for x in _gap.split(tidy(text)) if (u := x.strip())] or [text]
    return [" ".join(units[a:b]) for a, b in ranges([*map(tokens_of, units)], target, overlap)]


def cut_table(text: str, most: int) -> list[str]:
    """A Markdown table as tables of some of its rows, each under the header."""
    lines = text.split("\n")
    head = 2 if len(lines) > 2 and lines[1].strip().startswith("|") else 0
    top = lines[:head]
    return ["\n".join(top + lines[head + a : head + b]) for a, b in ranges([*map(tokens_of, lines[head:])], most - tokens_of("\n".join(top)), 0)]


def _path_key(path: Column) -> Column:
    return F.to_json(F.coalesce(path, F.array().cast("array<string>")))


def _packs(blocks: DataFrame, target: int) -> DataFrame:
    """Blocks with ``seg``, a run that no section, heading or atomic block interrupts, and ``pack``, its parts of up to ``target`` tokens."""
    in_order = Window.partitionBy("document_id").orderBy("block_order")
    atomic, path = F.col("modality").isin(ATOMIC), _path_key(F.col("section_path"))
    opens = F.col("heading_level").isNotNull() | atomic | F.coalesce(F.lag(atomic).over(in_order), F.lit(False)) | (path != F.coalesce(F.lag(path).over(in_order), F.lit("")))
    own = blocks.withColumn("opens", opens.cast("int")).withColumn("seg", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.filter(F.col("heading_level").isNull() | atomic)
    runs = own.groupBy("document_id", "seg").agg(F.array_sort(F.collect_list(F.struct("block_order", "text", "modality", "section", "section_path", X.estimate_tokens("text").alias("size")))).alias("b"))
    # (tokens of the open pack, its number, the number of each block so far)
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("all"))

    def place(state: Column, block: Column) -> Column:
        fits = (state["sum"] + block["size"] <= target) | (F.size(state["all"]) == 0)
        n = F.when(fits, state["n"]).otherwise(state["n"] + 1)
        return F.struct(F.when(fits, state["sum"]).otherwise(F.lit(0).cast("long")) + block["size"], n, F.concat(state["all"], F.array(n)))

    runs = runs.withColumn("number", F.aggregate("b", zero, lambda s, x: place(s, x).cast("struct<sum: bigint, n: int, all: array<int>>"), lambda s: s["all"]))
    return runs.select("document_id", "seg", F.explode(F.arrays_zip("b", "number")).alias("x")).select("document_id", "seg", F.col("x.number").alias("pack"), "x.b.*")


def chunk(blocks: DataFrame, target: int = 380, overlap: int = 60, least: int = 60) -> DataFrame:
    """(document_id, ordinal, content, modality, section, section_path, token_count): blocks packed into chunks within their section.

    Prose is packed up to ``target`` tokens; atomic blocks stay whole. What exceeds the ceiling is cut: prose at sentences, with up to
    ``overlap`` tokens carried over, tables by rows with their header repeated. Prose below ``least`` joins the prose chunk before it in its
    section. Boundaries are window expressions and packing is a fold over token counts in the JVM; only the cut runs in Python,
    on the texts that need it. A window or fold never spans more than one document, which is one file."""
    ceiling = int(target * CEILING)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([cut_table(t, ceiling) if k == "table" else cut_prose(t, target, overlap) for t, k in zip(texts, kinds, strict=True)])

    by = ["document_id", "seg", "pack"]
    first = F.min_by(F.struct("modality", "section", "section_path"), "block_order")
    solid = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("block_order", "text"))))
    packs = _packs(blocks, target).groupBy(*by).agg(first.alias("f"), F.array_join(F.transform(solid, lambda x: x["text"]), "\n\n").alias("body"))
    atomic = F.col("f.modality").isin(ATOMIC)
    packs = packs.select(*by, F.when(atomic, F.col("body")).otherwise(X.normalize_whitespace("body")).alias("body"), F.when(atomic | (F.col("f.modality") == "ocr"), F.col("f.modality")).otherwise("text").alias("modality"), "f.section", F.coalesce("f.section_path", F.array().cast("array<string>")).alias("section_path")).filter(F.trim("body") != "")
    long_ = (X.estimate_tokens("body") > ceiling) & F.col("modality").isin("table", "text", "ocr")
    whole = packs.filter(~long_).withColumn("parts", F.array("body"))
    parts = whole.unionByName(packs.filter(long_).withColumn("parts", cut("body", "modality")))
    parts = parts.select(*by, "modality", "section", "section_path", F.posexplode("parts").alias("i", "content")).filter(F.trim("content") != "")
    return _merged(parts, [*by, "i"], least, ceiling)


def _merged(parts: DataFrame, order: list[str], least: int, ceiling: int) -> DataFrame:
    """Small prose joined to what stands before it, and ordinals. Sizes of joined texts follow from characters and words alone."""
    in_order = Window.partitionBy("document_id").orderBy(*order)
    prose, path = ~F.col("modality").isin(ATOMIC), _path_key(F.col("section_path"))
    opens = ~prose | ~F.coalesce(F.lag(prose).over(in_order), F.lit(False)) | (path != F.coalesce(F.lag(path).over(in_order), F.lit("")))
    own = parts.withColumn("n", F.row_number().over(in_order)).withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    sized = F.struct("n", F.length("content").cast("long").alias("chars"), F.regexp_count("content", F.lit(r"\S+")).cast("long").alias("words"), "content", "modality", "section", "section_path")
    runs = own.groupBy("document_id", "run").agg(F.array_sort(F.collect_list(sized)).alias("p"))
    size = lambda chars, words: F.greatest(F.lit(1).cast("long"), F.floor(chars / 4), F.floor(words / 2))
    zero = F.struct(*(F.lit(0).cast("long").alias(x) for x in ("chars", "words", "n")), F.array().cast("array<bigint>").alias("all"))

    def place(state: Column, x: Column) -> Column:
        mine = size(x["chars"], x["words"])
        joins = (F.size(state["all"]) > 0) & ~x["modality"].isin(ATOMIC) & (mine < least) & (size(state["chars"], state["words"]) + mine <= ceiling)
        n = F.when(joins, state["n"]).otherwise(state["n"] + 1)
        return F.struct(F.when(joins, state["chars"] + 2 + x["chars"]).otherwise(x["chars"]), F.when(joins, state["words"] + x["words"]).otherwise(x["words"]), n, F.concat(state["all"], F.array(n)))

    kind = "struct<chars: bigint, words: bigint, n: bigint, all: array<bigint>>"
    runs = runs.withColumn("number", F.aggregate("p", zero, lambda s, x: place(s, x).cast(kind), lambda s: s["all"]))
    each = runs.select("document_id", "run", F.explode(F.arrays_zip("p", "number")).alias("x")).select("document_id", "run", F.col("x.number").alias("number"), "x.p.*")
    joined = each.groupBy("document_id", "run", "number").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "content"))).alias("c"), F.min_by(F.struct("modality", "section", "section_path"), "n").alias("f"))
    content = F.array_join(F.transform("c", lambda x: x["content"]), "\n\n")
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("n"))
    return joined.select("document_id", ordinal.alias("ordinal"), content.alias("content"), "f.modality", "f.section", "f.section_path").withColumn("token_count", X.estimate_tokens("content").cast("int"))


# Names that are no entities, and headings that carry relations.
STOP_ENTITIES = ["the model", "our model", "the dataset", "the method", "our approach", "the approach", "this paper", "the paper", "the system", "the network", "the results", "the data", "figure", "table", "section", "appendix", "we", "it", "they"]
RICH_SECTIONS = ["abstract", "method", "approach", "result", "experiment", "conclusion"]
ENTITY_TYPES = ["METHOD", "MODEL", "DATASET", "METRIC", "TASK", "ORGANIZATION", "PERSON", "TOOL", "CONCEPT", "ARCHITECTURE", "FRAMEWORK"]
RELATION_TYPES = ["USES", "PROPOSES", "EVALUATED_ON", "OUTPERFORMS", "EXTENDS", "PART_OF", "COMPARED_WITH", "TRAINED_ON", "ACHIEVES", "CITES", "AUTHORED_BY", "APPLIED_TO", "RELATED_TO"]


def select_chunks(chunks: DataFrame, most: int = 60) -> DataFrame:
    """The chunks of each document richest in technical terms per 100 tokens; method and result sections count 1.6 times."""
    tokens = X.estimate_tokens("content")
    score = F.size(X.technical_terms("content")) / F.greatest(F.lit(1.0), tokens / 100)
    rich = X.has_any(F.lower(F.array_join("section_path", " ")), RICH_SECTIONS)
    # exploded, so that the filter doesn't compute them a second time
    sized = F.explode(F.array(F.struct(tokens.alias("tokens"), F.round(score * F.when(rich, 1.6).otherwise(1.0), 9).alias("score"))))
    own = chunks.select("*", sized.alias("s")).select("*", "s.tokens", "s.score").drop("s").filter((F.col("tokens") >= 30) & (F.col("score") > 0))
    w = Window.partitionBy("document_id").orderBy(F.col("score").desc(), "ordinal")
    return own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def rule_entities(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, pos, name, key, entity_type, salience): up to ten technical terms of each chunk."""
    own = chunks.select("document_id", "chunk_id", F.posexplode(F.slice(X.technical_terms("content"), 1, 10)).alias("pos", "name")).withColumn("key", X.entity_key("name"))
    own = own.filter((F.length("name") >= 3) & ~F.col("key").isin(STOP_ENTITIES))
    return own.withColumns({"entity_type": F.lit("CONCEPT"), "salience": F.lit(0.45), "description": F.lit("")})


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """One row for each (document, key): highest salience, longest description, first type beyond CONCEPT, all chunks."""
    typed = F.when(F.col("entity_type") != "CONCEPT", F.struct("chunk_id", "pos"))
    return entities.filter(F.col("key") != "").groupBy("document_id", "key").agg(
        F.min_by("name", F.struct("chunk_id", "pos")).alias("name"), F.coalesce(F.min_by("entity_type", typed), F.lit("CONCEPT")).alias("entity_type"), F.max("salience").alias("salience"),
        F.max_by("description", F.length("description")).alias("description"), F.count(F.lit(1)).alias("mentions"), F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"),
    )


def valid_extractions(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A model's entities (document_id, chunk_id, name, entity_type[, salience, description]) and relations (document_id, chunk_id, source, target, relation_type[, confidence]) that hold.

    Names of up to 120 characters that aren't generic; unknown types become CONCEPT and RELATED_TO; numbers lie in 0 to 1, .5 where
    there is none. Both ends of a relation must be declared in its own chunk, and differ."""
    unit = lambda df, c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c).cast("double"), F.lit(0.5)))) if c in df.columns else F.lit(0.5)
    known = lambda c, types, other: F.when(c.isin(types), c).otherwise(other)
    name, bare = F.trim(F.coalesce("name", F.lit(""))), F.upper(F.trim(F.coalesce("entity_type", F.lit("CONCEPT"))))
    good = entities.withColumns({"name": name, "key": X.entity_key("name")}).filter((F.col("key") != "") & ~F.col("key").isin(STOP_ENTITIES) & (F.length("name") <= 120))
    good = good.withColumns({"entity_type": known(bare, ENTITY_TYPES, "CONCEPT"), "salience": unit(entities, "salience"), "description": F.substring(F.coalesce("description", F.lit("")), 1, 500) if "description" in entities.columns else F.lit("")})
    ends = good.select("document_id", "chunk_id", "key").distinct()
    kind = F.replace(F.upper(F.trim(F.coalesce("relation_type", F.lit("RELATED_TO")))), F.lit(" "), F.lit("_"))
    r = relations.withColumns({"src": X.entity_key("source"), "dst": X.entity_key("target"), "relation_type": known(kind, RELATION_TYPES, "RELATED_TO"), "confidence": unit(relations, "confidence")}).filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != ""))
    for end in ("src", "dst"):
        r = r.join(ends.withColumnRenamed("key", end), ["document_id", "chunk_id", end], "left_semi")
    return good, r


def co_occurrence(entities: DataFrame) -> DataFrame:
    """(src, dst, type, confidence, weight, chunk_id, document_id): entities of one chunk, at most ten, linked in name order.

    An extension: rules alone give no relations."""
    e = entities.select("document_id", "chunk_id", "key").distinct()
    pairs = e.withColumnRenamed("key", "src").join(e.withColumnRenamed("key", "dst"), ["document_id", "chunk_id"]).filter(F.col("src") < F.col("dst"))
    own = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.min("chunk_id").alias("chunk_id"), F.min("document_id").alias("document_id"))
    return own.select("src", "dst", F.lit("CO_OCCURS").alias("type"), F.round(F.least(F.lit(0.9), 0.4 + 0.1 * F.col("weight")), 4).alias("confidence"), "weight", "chunk_id", "document_id")


def hash_embed(df: DataFrame, text: str = "content", dim: int = 256, out: str = "vector") -> DataFrame:
    """Feature hashing of words and word pairs: bucket and sign from blake2b, weight 1 + ln(tf), unit length."""
    from collections import Counter
    from hashlib import blake2b

    import numpy as np

    stop, word = set(L.STOPWORDS), re.compile(L.WORD)
    known: dict[str, bytes] = {}

    def hashed(term: str) -> bytes:
        if (h := known.get(term)) is None:
            if len(known) > 1 << 16:
                known.clear()
            h = known[term] = blake2b(term.encode(), digest_size=8).digest()
        return h

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        rows = []
        for t in texts:
            w = [x for y in word.findall(t or "") if (x := y.lower()) not in stop and len(x) > 1]
            one, two = Counter(w), Counter(zip(w, w[1:], strict=False))  # a pair's name has a space, so that it is no word
            h = np.frombuffer(b"".join([*map(hashed, one), *(blake2b(f"{a} {b}".encode(), digest_size=8).digest() for a, b in two)]), ">u8")
            weight = np.array([1 + math.log(n) for n in (*one.values(), *two.values())])
            v = np.bincount((h % dim).astype(np.intp), np.where(h >> np.uint64(63), weight, -weight), dim)  # sums in this order
            norm = np.linalg.norm(v)
            rows.append((v / norm if norm else v).astype("float32"))
        return pd.Series(rows)

    return df.withColumn(out, embed(F.col(text)))
