"""A stored index over chunks: postings, vectors and graph, with upsert, delete by document, replacement, saving and loading.

Every change gives a new ``Index`` whose tables are anti-joins and unions of the old ones, so nothing is built anew but what changed;
the terms' statistics change by sums and differences.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import ingest as I
from lodestone.operators import retrieval as R
from lodestone.sources import versions
from lodestone.sources.stored import stored


@dataclass(frozen=True)
class Index:
    """Chunks (chunk_id, document_id, content, and what else they carry), postings, statistics of terms, vectors (chunk_id, vector), nodes and edges."""

    chunks: DataFrame
    posts: DataFrame
    terms: DataFrame
    vectors: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def save(self, path: str, parts: int | None = None) -> Index:
        """Written to a new folder of ``path`` and read back. Postings are clustered by term, so that a search skips most of their row groups."""
        spark = self.chunks.sparkSession
        for f in fields(self):
            df = getattr(self, f.name)
            if f.name == "posts":
                df = (df.repartitionByRange(parts, "term") if parts else df.repartitionByRange("term")).sortWithinPartitions("term")
            df.write.parquet(f"{path}/{f.name}")
        return load(spark, path)

    def stats(self) -> DataFrame:
        return R.term_idf(self.terms)

    def search(self, queries: DataFrame, limit: int, allowed: DataFrame | None = None) -> DataFrame:
        # the terms of a changed index are sums and differences over its postings, and their statistics read them several times
        return R.bm25(queries, self.posts, stored(R.term_idf(stored(self.terms, "terms")), "idf"), limit, allowed)

    def search_vectors(self, vectors: DataFrame, limit: int, threshold: float | None = None) -> DataFrame:
        return R.dense(vectors, self.vectors, limit, threshold)

    def counts(self) -> DataFrame:
        """(part, n): rows of each part; postings count by chunk."""
        out = None
        for name, n in (("chunks", F.count(F.lit(1))), ("posts", F.count_if("first")), ("vectors", F.count(F.lit(1))), ("nodes", F.count(F.lit(1))), ("edges", F.count(F.lit(1)))):
            own = getattr(self, name).agg(n.alias("n")).select(F.lit(name).alias("part"), "n")
            out = own if out is None else out.unionByName(own)
        return out


def publish(index: Index, path: str, base: versions.Version | None = None) -> versions.Version:
    """Writes the index as the next version of ``path``: readers see all its tables or none."""
    return versions.publish(index.chunks.sparkSession, path, {f.name: getattr(index, f.name) for f in fields(index)}, base)


def at_version(spark: SparkSession, path: str, number: int | None = None) -> Index | None:
    """The index of the last published version, or of ``number``; it stays the same whatever is published later."""
    found = versions.latest(spark, path, number)
    return None if found is None else Index(*(found.table(spark, f.name) for f in fields(Index)))


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(Index)))


def latest(chunks: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each chunk id, the last by ``order``."""
    own = chunks.groupBy("chunk_id").agg(F.max_by(F.struct(*(c for c in chunks.columns if c != "chunk_id")), F.col(order)).alias("r"))
    return own.select("chunk_id", "r.*")


def build(chunks: DataFrame, vectors: DataFrame | None = None) -> Index:
    """The index of ``chunks``; without ``vectors`` they are hashed from the text. Postings and terms are written; the other parts are plans until they are saved or read."""
    found = I.rule_entities(chunks)
    nodes = G.merge_entities(found.withColumn("seq", F.struct("chunk_id", "pos")))
    own = vectors if vectors is not None else I.hash_embed(chunks.select("chunk_id", "content"))
    posts = stored(R.postings(chunks), "postings")
    return Index(chunks, posts, stored(R.term_stats(posts), "terms"), own.select("chunk_id", "vector"), nodes, I.co_occurrence(found))


def _without(index: Index, gone: DataFrame) -> Index:
    """Without the chunks of ``gone`` (chunk_id)."""
    gone = stored(gone.distinct(), "gone")
    left = lambda df: df.join(gone, "chunk_id", "left_anti")
    terms = merge_terms(index.terms, R.term_stats(index.posts.join(gone, "chunk_id", "left_semi")), -1)
    return replace(index, chunks=left(index.chunks), posts=left(index.posts), terms=terms, vectors=left(index.vectors))


def merge_terms(old: DataFrame, new: DataFrame, sign: int = 1) -> DataFrame:
    """Statistics of terms with those of ``new`` added or, with a ``sign`` of -1, taken away; a term without postings goes."""
    numbers = ("df", "tf", "chunks", "words")
    both = old.unionByName(new.select("term", *((F.col(c) * sign).alias(c) for c in numbers)))
    return both.groupBy("term").agg(*(F.sum(c).alias(c) for c in numbers)).filter(F.col("df") > 0)


def delete_documents(index: Index, documents: DataFrame, chunks: DataFrame | None = None) -> Index:
    """Without the documents of ``documents`` (document_id), in every part: chunks, postings, vectors, edges; nodes lose them and go with their last.
    ``chunks`` (chunk_id) go in the same pass."""
    own = documents.select("document_id").distinct()
    gone = index.chunks.join(own, "document_id", "left_semi").select("chunk_id")
    out = _without(index, gone if chunks is None else gone.unionByName(chunks.select("chunk_id")))
    left = index.nodes.select("key", F.explode("documents").alias("document_id")).join(own, "document_id", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list("document_id")).alias("documents"))
    nodes = index.nodes.drop("documents").join(left, "key").select(*index.nodes.columns)
    ends = nodes.select("key")
    edges = index.edges.join(own, "document_id", "left_anti").join(ends.withColumnRenamed("key", "src"), "src", "left_semi").join(ends.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return replace(out, nodes=nodes, edges=edges)


def upsert(index: Index, chunks: DataFrame, vectors: DataFrame | None = None) -> Index:
    """With ``chunks``, which replace those of their ids; of several with one id the last by ``seq`` counts, if they have that column."""
    new = _last(chunks)
    return _with(_without(index, new.select("chunk_id")), new, vectors)


def _last(chunks: DataFrame) -> DataFrame:
    return latest(chunks).drop("seq") if "seq" in chunks.columns else chunks


def _with(left: Index, new: DataFrame, vectors: DataFrame | None) -> Index:
    """With the chunks of ``new``, whose ids ``left`` doesn't have."""
    fresh = build(new, vectors)
    joined = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return Index(joined(left.chunks, fresh.chunks), joined(left.posts, fresh.posts), merge_terms(left.terms, fresh.terms), joined(left.vectors, fresh.vectors), merge_nodes(left.nodes, fresh.nodes), merge_edges(left.edges, fresh.edges))


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of both: the older name, the first type other than CONCEPT, sums of mentions, highest salience, longest description."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    typed = F.when(F.col("type") != "CONCEPT", F.col("age"))
    return both.groupBy("key").agg(
        F.min_by("name", "age").alias("name"), F.coalesce(F.min_by("type", typed), F.lit("CONCEPT")).alias("type"), F.max("salience").alias("salience"), F.sum("mentions").alias("mentions"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("documents")))).alias("documents"), F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("age", "chunk_ids"))), lambda x: x["chunk_ids"]))), 1, 50).alias("chunk_ids"),
        F.max_by("description", F.struct(F.length("description"), -F.col("age"))).alias("description"),
    )


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both: highest confidence, sum of weights, the older evidence."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    return both.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"), F.sum("weight").alias("weight"), F.min_by("chunk_id", "age").alias("chunk_id"), F.min_by("document_id", "age").alias("document_id"))


def replace_documents(index: Index, chunks: DataFrame, vectors: DataFrame | None = None) -> Index:
    """Reindex: the documents of ``chunks`` go in every part before their chunks are added."""
    new = _last(chunks)
    return _with(delete_documents(index, chunks.select("document_id"), new.select("chunk_id")), new, vectors)


def chunk_counts(index: Index) -> DataFrame:
    """(document_id, chunks)."""
    return index.chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))


def document_detail(index: Index, entities: DataFrame, limit: int = 50, most_entities: int = 60) -> DataFrame:
    """(document_id, chunks, modalities, entities): for every document its first ``limit`` chunk ids by ordinal, chunks by modality and most salient entities."""
    w = Window.partitionBy("document_id")
    first = index.chunks.select("document_id", "chunk_id", "ordinal").withColumn("n", F.row_number().over(w.orderBy("ordinal"))).filter(F.col("n") <= limit)
    first = first.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))
    kinds = index.chunks.groupBy("document_id", "modality").agg(F.count(F.lit(1)).alias("n")).groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", "n")))).alias("modalities"))
    named = entities.withColumn("n", F.row_number().over(w.orderBy(F.col("salience").desc(), F.col("mentions").desc(), "key"))).filter(F.col("n") <= most_entities)
    named = named.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "key"))), lambda x: x["key"]).alias("entities"))
    return first.join(kinds, "document_id").join(named, "document_id", "left")
