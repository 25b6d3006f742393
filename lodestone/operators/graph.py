"""Entity graph: merge, delete, search, traversal, export. Nodes and edges are DataFrames; hops are joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.sources.stored import stored


def merge_entities(entities: DataFrame) -> DataFrame:
    """(key, name, type, salience, mentions, documents, chunk_ids, description) of (seq, name, entity_type, description, salience, document_id, chunk_id).

    The first name stays, the first type other than CONCEPT wins, the longest description stays, up to 50 chunks are listed."""
    own = entities.withColumn("key", X.entity_key("name")).filter(F.col("key") != "")
    typed = F.col("entity_type").isNotNull() & (F.col("entity_type") != "CONCEPT")
    return own.groupBy("key").agg(
        F.min_by("name", "seq").alias("name"),
        F.coalesce(F.min_by("entity_type", F.when(typed, F.col("seq"))), F.lit("CONCEPT")).alias("type"),
        F.max("salience").alias("salience"),
        F.count(F.lit(1)).alias("mentions"),
        F.sort_array(F.collect_set("document_id")).alias("documents"),
        F.slice(F.sort_array(F.collect_set("chunk_id")), 1, 50).alias("chunk_ids"),
        F.min_by("description", F.struct(-F.length("description"), F.col("seq"))).alias("description"),
    )


def merge_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, type, confidence, weight, chunk_id, document_id): one edge for each (src, type, dst) with both ends known, no loops;
    highest confidence, first evidence."""
    own = relations.withColumns({"src": X.entity_key("source"), "dst": X.entity_key("target"), "type": F.coalesce("relation_type", F.lit("RELATED_TO"))})
    own = own.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    own = own.join(nodes.select(F.col("key").alias("src")), "src", "left_semi").join(nodes.select(F.col("key").alias("dst")), "dst", "left_semi")
    return own.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("weight"), F.min_by("chunk_id", "seq").alias("chunk_id"), F.min_by("document_id", "seq").alias("document_id"))


def delete_document(nodes: DataFrame, edges: DataFrame, document_id) -> tuple[DataFrame, DataFrame]:
    """Without a document's edges; nodes lose the document and go when it was their last."""
    kept = edges.filter(F.col("document_id") != document_id)
    left = nodes.withColumn("documents", F.array_remove("documents", document_id)).filter(F.size("documents") > 0)
    ends = left.select("key")
    kept = kept.join(ends.withColumnRenamed("key", "src"), "src", "left_semi").join(ends.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return left, kept


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("key").join(ends, "key", "left").na.fill(0, ["degree"])


def _grams(key: Column) -> Column:
    """The distinct runs of one to three characters of a key: if one key contains another, it has the other's first three characters among them."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key)))
    runs = lambda n: F.transform(at, lambda i: F.substring(key, i, F.lit(n)))
    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def _rarest(keys: DataFrame, text: str, common: DataFrame) -> DataFrame:
    """``keys`` with ``g``: of the runs of three characters of ``text`` (the whole, if it is shorter) the one that the fewest keys of ``common`` (g, n) have.

    Whatever contains the text has this run, so candidates for containment meet under it, and a beginning that many names share isn't a hot key."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2))
    runs = keys.select("*", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(3))))).alias("g"))
    own = runs.join(common, "g", "left")
    rest = [c for c in keys.columns]
    return own.groupBy(*rest).agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), F.col("g"))).alias("g"))


def search_entities(queries: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, key, score, rank): equal names, contained names, token overlap, plus a little for mentions.

    Candidates meet in equi-joins, on the rarest run of three characters for containment and on tokens for overlap; only they are scored."""
    q = queries.select("query_id", X.entity_key("query").alias("qk"), F.array_distinct(X.tokenize("query")).alias("qt")).distinct()
    n = nodes.select("key", "mentions", F.array_distinct(X.tokenize("name", content=False)).alias("nt"))
    posted = n.filter("key <> ''").select("key", F.explode(_grams(F.col("key"))).alias("g"))
    common = stored(posted.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "runs")
    inside = q.select("query_id", F.explode(_grams(F.col("qk"))).alias("g")).join(_rarest(n.filter("key <> ''").select("key").distinct(), "key", common), "g")
    around = _rarest(q.filter("qk <> ''").select("query_id", "qk").distinct(), "qk", common).select("query_id", "g").join(posted, "g")
    shared = q.select("query_id", F.explode("qt").alias("g")).join(n.select("key", F.explode("nt").alias("g")), "g")
    pairs = inside.select("query_id", "key").unionByName(around.select("query_id", "key")).unionByName(shared.select("query_id", "key")).distinct()
    both = pairs.join(q, "query_id").join(n, "key")
    key, qk = F.col("key"), F.col("qk")
    overlap = F.size(F.array_intersect("qt", "nt")) / F.nullif(F.size("nt"), F.lit(0)) * 0.7
    score = F.when((qk != "") & (qk == key), 1.0).when((qk != "") & F.contains(key, qk), 0.85).when(F.contains(qk, key), 0.8).otherwise(F.coalesce(overlap, F.lit(0.0)))
    hit = both.withColumn("s", score).filter(F.col("s") > 0.05).withColumn("score", F.round(F.col("s") + F.least(F.lit(0.1), F.col("mentions") * 0.01), 4))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    return hit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "key", "score", "rank")


def search_entities_by_degree(queries: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """The other store's answer: names that contain the query, the best connected first, all at 1.0."""
    own = queries.select("query_id", F.lower("query").alias("low")).filter("low <> ''")
    names = nodes.select("key", F.lower("name").alias("name"))
    head = own.select("query_id", "low", F.substring("low", 1, 3).alias("g")).join(names.select("key", "name", F.explode(_grams(F.col("name"))).alias("g")), "g")
    hit = head.filter(F.contains("name", F.col("low"))).select("query_id", "key").distinct().join(degrees(nodes, edges), "key")
    w = Window.partitionBy("query_id").orderBy(F.col("degree").desc(), "key")
    return hit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "key", F.lit(1.0).alias("score"), "rank")


def _steps(edges: DataFrame) -> DataFrame:
    """Edges in both directions, one for each pair of nodes: out before in, then type."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type", "confidence", "chunk_id", F.lit(0).alias("back"))
    both = out.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "type", "confidence", "chunk_id", F.lit(1).alias("back")))
    return both.groupBy("a", "b").agg(F.min(F.struct("back", "type", "confidence", "chunk_id")).alias("e")).select("a", "b", "e.*")


def neighborhood(seeds: DataFrame, edges: DataFrame, depth: int = 2, limit: int | Column = 60, per: str = "seed", weakest: bool = False) -> DataFrame:
    """(seed, path, types, chunks, hops, score, rank): simple paths from each seed (key), scored by the last edge's confidence times .75 a hop.

    ``per`` is what ``limit`` counts for: each seed, or another column of ``seeds`` (a question, whose seeds share the limit), which is returned
    as well; ``limit`` and ``depth`` may also be columns of ``seeds``. ``weakest`` scores by a path's least confidence, as the other store does. One join for each hop."""
    steps, group = _steps(edges), [] if per == "seed" else [per]
    most = depth if isinstance(depth, int) else 4
    carried = [c for c in ("depth", "limit") if c in seeds.columns]
    none = F.array().cast("array<string>")
    now = seeds.select(*group, *carried, F.col("key").alias("seed"), F.array("key").alias("path"), none.alias("types"), none.alias("chunks"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("have"))
    out, by, enough = None, per if group else "seed", F.col("limit") if "limit" in carried else F.lit(limit)
    for hop in range(1, most + 1):
        here = now.filter(F.col("depth") >= hop) if "depth" in carried else now
        if hop > 1:  # whoever has enough shorter paths goes no further, so a hub doesn't multiply them
            here = here.withColumn("have", F.col("have") + F.count(F.lit(1)).over(Window.partitionBy(by))).filter(F.col("have") < enough)
        now = here.withColumn("a", F.element_at("path", -1)).withColumnRenamed("confidence", "before").join(steps, "a").filter(~F.array_contains("path", F.col("b")))
        strength = F.least("before", "confidence") if weakest else F.col("confidence")
        now = now.select(*group, *carried, "seed", F.concat("path", F.array("b")).alias("path"), F.concat("types", F.array("type")).alias("types"), F.concat("chunks", F.array("chunk_id")).alias("chunks"), strength.alias("confidence"), "have")
        # results are ordered by hops and path, so of a hub's neighbours only as many as are still wanted go on
        now = now.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("path"))).filter(F.col("nth") <= enough - F.col("have")).drop("nth")
        own = now.select(*group, *carried, "seed", "path", "types", "chunks", F.lit(hop).alias("hops"), F.round(F.col("confidence") * 0.75 ** (hop - 1), 4).alias("score"))
        out = own if out is None else out.unionByName(own)
    w = Window.partitionBy(by).orderBy("hops", "path")
    found = out.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= enough)  # breadth first, then the limit
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), "hops", "path"))).drop("n", *carried)


def paths_between(pairs: DataFrame, edges: DataFrame, max_depth: int = 4, limit: int = 10) -> DataFrame:
    """(src, dst, path, chunks, hops, score): up to ``limit`` simple undirected paths of each pair, shorter first, score .9 a hop beyond the first.

    The last hop of a path is looked up by both of its ends, so paths that miss the target are never made."""
    steps = _steps(edges).select("a", "b", "chunk_id")
    carried = ["depth"] if "depth" in pairs.columns else []
    now, out = pairs.select("src", "dst", *carried, F.array("src").alias("path"), F.array().cast("array<string>").alias("chunks")).distinct(), None
    for hop in range(1, max_depth + 1):
        here = (now.filter(F.col("depth") >= hop) if carried else now).withColumn("a", F.element_at("path", -1)).filter(F.col("a") != F.col("dst"))
        own = here.join(steps.withColumnRenamed("b", "dst"), ["a", "dst"]).select("src", "dst", F.concat("path", F.array("dst")).alias("path"), F.concat("chunks", F.array("chunk_id")).alias("chunks"), F.lit(hop).alias("hops"), F.lit(round(0.9 ** (hop - 1), 4)).alias("score"))
        out = own if out is None else out.unionByName(own)
        if hop < max_depth:
            now = here.join(steps, "a").filter(~F.array_contains("path", F.col("b")) & (F.col("b") != F.col("dst"))).select("src", "dst", *carried, F.concat("path", F.array("b")).alias("path"), F.concat("chunks", F.array("chunk_id")).alias("chunks"))
    w = Window.partitionBy("src", "dst").orderBy("hops", "path")
    return out.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).drop("n")


def shortest(pairs: DataFrame, edges: DataFrame, max_depth: int = 4) -> DataFrame:
    """The shortest of ``paths_between``, the other store's answer."""
    found = paths_between(pairs, edges, max_depth)
    return found.withColumn("least", F.min("hops").over(Window.partitionBy("src", "dst"))).filter(F.col("hops") == F.col("least")).drop("least")


def export(nodes: DataFrame, edges: DataFrame, limit: int = 300, document_id=None) -> tuple[DataFrame, DataFrame]:
    """Nodes of the highest degree and the edges among them; ``truncated`` on the nodes says whether some were left out."""
    own = nodes if document_id is None else nodes.filter(F.array_contains("documents", document_id))
    total = own.agg((F.count(F.lit(1)) > limit).alias("truncated"))  # one row
    top = own.join(degrees(nodes, edges), "key").orderBy(F.col("degree").desc(), "key").limit(limit).crossJoin(F.broadcast(total))
    ends = top.select("key")
    inner = edges.join(ends.withColumnRenamed("key", "src"), "src", "left_semi").join(ends.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return top, inner


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): totals, types of nodes and edges, and the ten highest degrees."""
    total = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit("nodes").alias("name"), "n").unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit("edges").alias("name"), "n"))
    types = nodes.groupBy("type").count().select(F.lit("node_type").alias("kind"), F.col("type").alias("name"), F.col("count").alias("n"))
    links = edges.groupBy("type").count().select(F.lit("edge_type").alias("kind"), F.col("type").alias("name"), F.col("count").alias("n"))
    top = degrees(nodes, edges).orderBy(F.col("degree").desc(), "key").limit(10).select(F.lit("top_degree").alias("kind"), F.col("key").alias("name"), F.col("degree").alias("n"))
    return total.unionByName(types).unionByName(links).unionByName(top)


def subgraph(paths: DataFrame) -> DataFrame:
    """Distinct (src, dst, type) steps of paths, with the path's own direction."""
    step = paths.select(F.posexplode("types").alias("i", "type"), "path")
    return step.select(F.element_at("path", F.col("i") + 1).alias("src"), F.element_at("path", F.col("i") + 2).alias("dst"), "type").distinct()


def documents_for_entity(nodes: DataFrame, documents: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents of each entity of ``keys`` (key)."""
    own = nodes.join(keys.select("key"), "key", "left_semi").select("key", F.explode("documents").alias("document_id"))
    return own.join(documents, "document_id")


def describe(paths: DataFrame) -> DataFrame:
    """Each path as text and with its distinct chunks."""
    hops = F.zip_with(F.slice("path", 2, F.size("path")), "types", lambda n, t: F.concat(F.lit(" -["), t, F.lit("]-> "), n))
    return paths.withColumns({"text": F.concat(F.element_at("path", 1), F.array_join(hops, "")), "path_chunks": F.array_distinct(F.filter("chunks", lambda c: c.isNotNull() & (c != "")))})
