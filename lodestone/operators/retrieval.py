"""Index build and search: postings, BM25 and cosine top-k, hydration, neighbours, fusion and reranking.

Queries are a DataFrame and every operator works on all of them at once.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.sources.stored import stored

# Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "content") -> DataFrame:
    """(chunk_id, dl, first, term, tf): function words stay in the index. A chunk's words are counted in its own row, so nothing is
    shuffled; ``first`` marks one row of each chunk, and a chunk without words has one with a null term."""
    own = chunks.select(F.col(chunk_id).alias("chunk_id"), F.explode(F.array(X.tokenize(text, content=False))).alias("w"))
    own = own.select("chunk_id", F.size("w").cast("long").alias("dl"), F.posexplode_outer(X.term_counts(F.col("w"))).alias("pos", "term", "tf"))
    return own.select("chunk_id", "dl", (F.coalesce("pos", F.lit(0)) == 0).alias("first"), "term", F.col("tf").cast("long").alias("tf"))


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, df, tf, chunks, words): what scoring needs of the corpus, from one pass over the postings; sums of chunks and words are of the corpus."""
    first = F.col("first")
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"), F.count_if(first).alias("chunks"), F.sum(F.when(first, F.col("dl")).otherwise(0)).alias("words"))


def term_idf(stats: DataFrame) -> DataFrame:
    """(term, df, tf, idf, avgdl): a negative idf becomes EPSILON times the mean over the vocabulary."""
    whole = stats.agg(F.sum("chunks").alias("n"), (F.sum("words") / F.sum("chunks")).alias("avgdl"))  # one row
    raw = stats.filter(F.col("term").isNotNull()).crossJoin(F.broadcast(whole)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", "tf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")


def bm25(queries: DataFrame, posts: DataFrame, idf: DataFrame, limit: int, allowed: DataFrame | None = None, query_id: str = "query_id", query: str = "query", part: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, *part, chunk_id, raw, score, rank). Corpus statistics cover all chunks; ``allowed`` (chunk_id, *part) only filters results, and
    each value of ``part`` has a list of its own.

    ``posts`` and ``idf`` should be written tables: both are read more than once. Postings meet the queries' terms before any exchange, sums are combined before the shuffle, and top-k windows are over a query's matches."""
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(X.tokenize(query, content=False)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))
    # written: Spark then knows the size of this side, sends it to the postings where it is small and else splits the postings' hot terms
    terms = stored(terms.join(idf.select("term", "idf", "avgdl"), "term"), "terms")
    weight = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    use = posts if allowed is None else posts.join(allowed.select("chunk_id", *part), "chunk_id")
    raw = use.join(terms, "term").groupBy("query_id", *part, "chunk_id").agg(F.sum(weight).alias("raw")).filter(F.col("raw") > 0)
    best = Window.partitionBy("query_id", *part)
    ranked = raw.withColumn("rank", F.row_number().over(best.orderBy(F.round("raw", 9).desc(), "chunk_id"))).filter(F.col("rank") <= limit)
    return ranked.withColumn("score", F.round(F.col("raw") / F.max("raw").over(best), 6))


#: Queries whose vectors are sent to the tasks together, about.
QUERY_BLOCK = 2048


def dense(queries: DataFrame, vectors: DataFrame, limit: int, threshold: float | None = None, exclude_self: bool = False, part: str | None = None) -> DataFrame:
    """(query_id, *part, chunk_id, score, rank) by cosine over all vectors: the exact search of a stated query set, in blocks.

    The vectors of up to ``QUERY_BLOCK`` queries are sent to the tasks; a batch of vectors meets them in one matrix product and
    passes on its best ``limit`` of each query, so the shuffle holds a few rows a task. ``part`` names a column of ``vectors`` each of
    whose values has a list of its own."""
    spark, sch = vectors.sparkSession, {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *vectors.schema.fields]}
    n = queries.count()
    parts = -(-n // QUERY_BLOCK)
    blocks = [queries] if parts <= 1 else [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]
    names = ["query_id", *([part] if part else []), "chunk_id", "score"]
    kinds = f"query_id {sch['query_id']}, {f'{part} {sch[part]}, ' if part else ''}chunk_id {sch['chunk_id']}, score double"
    found = None
    for own in blocks:
        rows = own.select("query_id", "vector").toPandas()  # about QUERY_BLOCK rows
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), _unit(rows["vector"])))

        def run(batches, shared=shared):
            ids, q = shared.value
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                scores = _unit(pdf["vector"]) @ q.T
                rounded = np.sign(scores) * np.floor(np.abs(scores) * 1e6 + 0.5)
                chunk, groups = pdf["chunk_id"].to_numpy(), [np.arange(len(pdf))] if part is None else [g.to_numpy() for g in pdf.reset_index(drop=True).groupby(part, dropna=False).groups.values()]
                out = []
                for i in range(len(ids)):
                    for g in groups:
                        if exclude_self:
                            g = g[chunk[g] != ids[i]]
                        r = rounded[g, i]
                        if len(g) > limit:  # the best of the batch; of equal scores the least ids
                            least = -np.partition(-r, limit - 1)[limit - 1]
                            sure, tied = g[r > least], g[r == least]
                            g = np.concatenate((sure, tied[np.argsort(chunk[tied], kind="stable")][: limit - len(sure)]))
                        if len(g):
                            out.append((np.full(len(g), i), g))
                if out:  # one frame a batch, not one a query
                    i, g = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pd.DataFrame({"query_id": ids[i], **({part: pdf[part].to_numpy()[g]} if part else {}), "chunk_id": chunk[g], "score": scores[g, i]})[names]

        hits = vectors.select(*([part] if part else []), "chunk_id", "vector").mapInPandas(run, kinds)
        found = hits if found is None else found.unionByName(hits)
    scored = found.withColumn("score", F.round("score", 6))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    w = Window.partitionBy("query_id", *([part] if part else [])).orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.array([np.asarray(x, np.float64) for x in vectors]).reshape(len(vectors), -1)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm == 0, 1.0, norm)


def payload_filter(chunks: DataFrame, documents: list | None = None, modalities: list[str] | None = None, excluded: list | None = None) -> DataFrame:
    out = chunks
    if documents:
        out = out.filter(F.col("document_id").isin(documents))
    if modalities:
        out = out.filter(F.col("modality").isin(modalities))
    if excluded:
        out = out.filter(~F.col("chunk_id").isin(excluded))
    return out


def hydrate(ranked: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Ranked ids with their chunk and document; ids without a chunk go."""
    return ranked.join(chunks, "chunk_id").join(documents, "document_id", "left")


def expand_neighbors(ranked: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Chunks within ``window`` ordinals of a ranked one in its document, at .35 of the best score, without those already there."""
    here = ranked.join(chunks.select("chunk_id", "document_id", "ordinal"), "chunk_id")
    beside = F.array(*(F.col("ordinal") + i for i in range(-window, window + 1) if i))
    want = here.select("query_id", "document_id", "score", F.explode(beside).alias("ordinal"))
    want = want.groupBy("query_id", "document_id", "ordinal").agg(F.max("score").alias("near"))
    best = ranked.groupBy("query_id").agg(F.max("score").alias("best"))
    found = want.join(chunks.select("document_id", "ordinal", "chunk_id"), ["document_id", "ordinal"]).join(best, "query_id")
    return found.join(ranked.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.round(0.35 * F.col("best"), 6).alias("score"))


def around(chunks: DataFrame) -> DataFrame:
    """Each chunk with the ids before and after it in its document."""
    w = Window.partitionBy("document_id").orderBy("ordinal")
    return chunks.select("chunk_id", "document_id", "ordinal", F.lag("chunk_id").over(w).alias("before"), F.lead("chunk_id").over(w).alias("after"))


def _ranked(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w))


def rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, strategy, list_no, rank, chunk_id, score): normalised by a query's best.

    A column ``weight`` of the lists is their weight where ``weights`` doesn't name the list. Ties keep the order in which chunks
    first appear, list by list."""
    weight = F.col("weight") if "weight" in lists.columns else F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("strategy") == name, w).otherwise(weight)
    own = lists.withColumn("part", weight / (k + F.col("rank")))
    best = Window.partitionBy("query_id")
    fused = own.groupBy("query_id", "chunk_id").agg(
        F.sum("part").alias("raw"),
        F.min(F.struct("list_no", "rank")).alias("first"),
        F.sort_array(F.collect_set("strategy")).alias("sources"),
    )
    fused = fused.withColumn("score", F.round(F.col("raw") / F.max("raw").over(best), 6))
    return _ranked(fused).select("query_id", "chunk_id", F.round("raw", 6).alias("rrf_raw"), "score", "rank", "sources")


def weighted_fusion(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of scores over their list's best, normalised by a query's best."""
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("strategy") == name, w).otherwise(weight)
    top = F.max("score").over(Window.partitionBy("query_id", "strategy"))
    own = lists.withColumn("part", weight * F.col("score") / F.when(top == 0, 1.0).otherwise(top))
    fused = own.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("raw"), F.min(F.struct("list_no", "rank")).alias("first"))
    most = F.max("raw").over(Window.partitionBy("query_id"))
    fused = fused.withColumn("score", F.round(F.col("raw") / F.when(most == 0, 1.0).otherwise(most), 6))
    return _ranked(fused).select("query_id", "chunk_id", "score", "rank")


def provenance(lists: DataFrame) -> DataFrame:
    """Sources, best score of each strategy and longest content of every fused chunk."""
    per = lists.groupBy("query_id", "chunk_id", "strategy").agg(F.round(F.max("score"), 6).alias("best"), F.max_by("content", F.struct(F.length("content"), -F.col("list_no"))).alias("content"))
    return per.groupBy("query_id", "chunk_id").agg(
        F.sort_array(F.collect_set("strategy")).alias("sources"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("strategy", "best")))).alias("strategy_scores"),
        F.max_by("content", F.length("content")).alias("content"),
    )


def diversify(ranked: DataFrame, per_document: int | Column) -> DataFrame:
    """The first ``per_document`` of each document stay in front, the rest follows; a single document is left alone, and so is a null ``per_document``."""
    nth = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("rank"))
    documents = F.size(F.collect_set("document_id").over(Window.partitionBy("query_id")))
    own = ranked.withColumn("late", F.coalesce((nth > per_document) & (documents > 1), F.lit(False)))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("late", "rank"))).drop("late")


def similar_pairs(ranked: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(query_id, a, b, similarity): chunks of one query and document whose TF cosine reaches ``threshold``; a ranks before b.

    Candidates of one query are few (its pool), so its pairs within a document are compared in one place, over words counted once a chunk."""
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    own = ranked.select("query_id", "document_id", "chunk_id", "rank", X.tokenize("content").alias("w"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "a": [], "b": [], "similarity": []}
        for _, same in pdf.dropna(subset=["document_id"]).sort_values("rank", kind="stable").groupby("document_id", sort=False):
            rows = []
            for chunk, rank, words in zip(same["chunk_id"], same["rank"], same["w"], strict=True):
                tf = Counter(words)
                norm = math.sqrt(sum(n * n for n in tf.values()))
                for before, before_rank, other, other_norm in rows:
                    if before_rank < rank and norm and other_norm:
                        few, many = (tf, other) if len(tf) < len(other) else (other, tf)
                        similarity = float(sum(n * many.get(w, 0) for w, n in few.items())) / (other_norm * norm)
                        if similarity > threshold - 1e-6:
                            for k, v in zip(out, (same["query_id"].iat[0], before, chunk, similarity), strict=True):
                                out[k].append(v)
                rows.append((chunk, rank, tf, norm))
        return pd.DataFrame(out)

    pairs = own.groupBy("query_id").applyInPandas(compare, f"query_id {kinds['query_id']}, a {kinds['chunk_id']}, b {kinds['chunk_id']}, similarity double")
    return pairs.withColumn("similarity", F.round("similarity", 9)).filter(F.col("similarity") >= threshold)


def deduplicate(ranked: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Greedy near-duplicate removal in rank order: a chunk goes if a *kept* chunk before it is as similar as that.

    The similarities come from ``similar_pairs``; only the greedy pass over a query's chunks with a partner is sequential."""
    pairs = similar_pairs(ranked, threshold)
    ranks = ranked.select("query_id", "chunk_id", "rank")
    edges = pairs.join(ranks.withColumnsRenamed({"chunk_id": "b", "rank": "rb"}), ["query_id", "b"])

    def greedy(pdf):
        gone, kept_by = set(), []
        before = pdf.groupby("b")["a"].agg(list).to_dict()
        for b in pdf[["rb", "b"]].drop_duplicates().sort_values("rb")["b"]:
            if any(a not in gone for a in before[b]):
                gone.add(b)
                kept_by.append(b)
        return pdf.head(0)[["query_id", "b"]] if not kept_by else pdf.drop_duplicates("b").loc[lambda d: d["b"].isin(kept_by), ["query_id", "b"]]

    fields = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    gone = edges.groupBy("query_id").applyInPandas(greedy, f"query_id {fields['query_id']}, b {fields['chunk_id']}")
    left = ranked.join(gone.withColumnRenamed("b", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def heuristic_rerank(ranked: DataFrame, prefer: list[str] | Column | None = None, apply: Column | None = None) -> DataFrame:
    """Needs query, content, score, n_sources, modality, ordinal and token_count; gives score and rank anew, where ``apply`` holds.

    ``prefer`` are favoured modalities, as a list or a column of arrays."""
    terms = F.array_distinct(F.transform(X.technical_terms("query"), F.lower))
    covered = X.coverage(X.tokenize("query"), X.tokenize("content"))
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower("content"), t)))
    exact = F.when(F.size(terms) == 0, 0.0).otherwise(hits / F.size(terms))
    agreed = F.least(F.lit(0.12), 0.06 * F.greatest(F.lit(0), F.col("n_sources") - 1))
    preferred = F.array_contains(prefer, F.col("modality")) if isinstance(prefer, Column) else F.col("modality").isin(prefer or [])
    favoured = F.when(preferred, 0.10).otherwise(0.0)
    early = F.when(F.col("ordinal") <= 3, 0.03).otherwise(0.0)
    short = F.when((F.col("token_count") > 0) & (F.col("token_count") < 40), -0.08).otherwise(0.0)
    score = F.col("score") * 0.62 + covered * 0.16 + exact * 0.14 + agreed + favoured + early + short
    new = ranked.withColumns({"base": F.col("score"), "coverage": covered, "exact": exact})
    new = new.withColumn("score", F.when(F.lit(True) if apply is None else apply, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)).otherwise(F.col("score")))
    by = F.col("score").desc() if apply is None else F.when(apply, F.col("score")).desc()
    return new.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by, "rank")))


def flat_scores(ranked: DataFrame, threshold: float = 0.045) -> DataFrame:
    """(query_id, spread, flat): whether the first eight scores are nearly equal; fewer than three never are."""
    own = ranked.filter(F.col("rank") <= 8).groupBy("query_id").agg(F.stddev_pop("score").alias("spread"), F.count(F.lit(1)).alias("n"))
    return own.select("query_id", F.round("spread", 6).alias("spread"), ((F.col("n") >= 3) & (F.col("spread") < threshold)).alias("flat"))


def blend_judged(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """Blend with a judge table (query_id, chunk_id, judged): .4 own and .6 judged; what it left out counts .55."""
    both = ranked.join(judged, ["query_id", "chunk_id"], "left")
    score = F.when(F.col("judged").isNotNull(), 0.4 * F.col("score") + 0.6 * F.col("judged")).otherwise(0.55 * F.col("score"))
    new = both.withColumn("score", F.round(score, 6)).drop("judged")
    return new.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")))


def truncate(ranked: DataFrame, top_k: int) -> DataFrame:
    return ranked.filter(F.col("rank") <= top_k)


def result_summary(ranked: DataFrame) -> DataFrame:
    """Top and mean score, results and distinct documents, in order of appearance, of each query."""
    own = ranked.groupBy("query_id").agg(F.max("score").alias("top_score"), F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("results"), F.sort_array(F.collect_list(F.struct("rank", "document_id"))).alias("in_order"))
    return own.select("query_id", "top_score", F.round("mean_score", 6).alias("mean_score"), "results", F.array_distinct(F.transform("in_order", lambda x: x["document_id"])).alias("documents"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, common): results that both lists have."""
    return a.select("query_id", "chunk_id").intersect(b.select("query_id", "chunk_id")).groupBy("query_id").agg(F.count(F.lit(1)).alias("common"))
