"""Retrieval strategies as compositions over a corpus: every strategy answers all queries at once.

The searches of a set of queries run once, at the widest pool (``searches``); each strategy then takes the front of the lists it
needs. What may differ between queries (results, pool, weights, depth, reranking) are columns of a settings table, so a routed set of
queries takes one pass for each strategy and not one for each setting. Steps that call a model are hooks; without one the
deterministic path runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import analyze as A
from lodestone.operators import graph as G
from lodestone.operators import ingest as I
from lodestone.operators import retrieval as R
from lodestone.operators import verify as V
from lodestone.sources.stored import stored


@dataclass
class Config:
    """The default settings of retrieval."""

    top_k: int = 8
    pool: int = 40
    min_score: float = 0.28
    floor: float = 0.45
    dense_weight: float = 0.5
    sparse_weight: float = 0.5
    graph_depth: int = 2
    rerank: bool = True
    modalities: list[str] = field(default_factory=list)


#: Modalities that are seen rather than read, and the pool that no strategy but graph exceeds.
VISUAL = ["figure", "image", "table", "ocr"]
POOL = 40
#: Longest list that any setting or repair asks for.
WIDEST = 80
NAMES = ["query_id", "chunk_id", "score", "rank", "sources"]


@dataclass
class Corpus:
    """Chunks (chunk_id, document_id, content, modality, token_count), their ordinals (chunk_id, ordinal) and what is built from them once, as far as the strategies that run read it (``NEEDS``)."""

    chunks: DataFrame
    ordinals: DataFrame
    posts: DataFrame | None
    idf: DataFrame | None
    vectors: DataFrame | None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    embed: Callable[[DataFrame, str], DataFrame] = lambda df, c: I.hash_embed(df, c)
    #: Model hooks: from (query_id, query) to (query_id, query) with a hypothetical passage; from poor queries (query_id, query, diagnosis)
    #: to rewrites (query_id, n, rewrite); from queries and results to (query_id, chunk_id, judged).
    hypothesis: Callable[[DataFrame], DataFrame] | None = None
    rewrites: Callable[[DataFrame], DataFrame] | None = None
    judge: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    #: From (query_id, query) to steps (query_id, step, sub_question, tool, depends_on); from queries, executed steps and fused results to
    #: (query_id, sufficient, next_query, next_tool).
    planner: Callable[[DataFrame], DataFrame] | None = None
    reflect: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None


def word_index(chunks: DataFrame) -> dict[str, DataFrame]:
    posts = stored(R.postings(chunks), "postings")
    return {"posts": posts, "idf": stored(R.term_idf(stored(R.term_stats(posts), "terms")), "idf")}


def vector_index(chunks: DataFrame) -> dict[str, DataFrame]:
    return {"vectors": stored(I.hash_embed(chunks.select("chunk_id", "modality", "content")).select("chunk_id", "modality", "vector"), "vectors")}


def entity_graph(chunks: DataFrame) -> dict[str, DataFrame]:
    found = stored(I.rule_entities(chunks), "entities")
    return {"nodes": stored(G.merge_entities(found.withColumn("seq", F.struct("chunk_id", "pos"))), "nodes"), "edges": stored(I.co_occurrence(found), "edges")}


#: What is made of the chunks, and which of it and which searches each strategy reads. Composite ones may run any other, but for the corrective one, which has a base.
PARTS: dict[str, Callable[[DataFrame], dict[str, DataFrame]]] = {"words": word_index, "vectors": vector_index, "graph": entity_graph}
NEEDS = {"naive": ["vectors"], "hybrid": ["vectors", "words"], "hyde": ["vectors"], "multimodal": ["vectors", "words"], "graph": ["vectors", "graph"], "corrective": ["vectors", "words"], "adaptive": [*PARTS], "agentic": [*PARTS]}
LISTS = {"naive": ["dense"], "hybrid": ["dense", "sparse"], "hyde": ["dense", "hypothesis"], "multimodal": ["dense", "visual", "visual_words"], "graph": ["dense"]}


def build(chunks: DataFrame, ordinals: DataFrame, with_graph: bool = True) -> Corpus:
    """The indexes of ``chunks``, written once; every strategy reads them several times."""
    made = {"posts": None, "idf": None, "vectors": None}
    for name, make in PARTS.items():
        if with_graph or name != "graph":
            made |= make(chunks)
    return Corpus(chunks, ordinals, **made)


def settings(queries: DataFrame, config: Config = Config()) -> DataFrame:
    """(query_id, query, and a column for each setting): the same for all queries."""
    given = {"top_k": config.top_k, "pool": config.pool, "min_score": config.min_score, "dense_weight": config.dense_weight, "sparse_weight": config.sparse_weight, "depth": config.graph_depth, "rerank": config.rerank}
    return queries.select("query_id", "query").withColumns({k: F.lit(v) for k, v in given.items()}).withColumn("modalities", F.array(*map(F.lit, config.modalities)).cast("array<string>"))


def searches(queries: DataFrame, corpus: Corpus, names: list[str] | None = None) -> DataFrame:
    """(query_id, list, modality, chunk_id, score, raw, rank): the lists of all searches, or of those that the strategies ``names`` read, at ``WIDEST``; those of visual chunks by modality."""
    wanted = {x for n in (names or LISTS) for x in LISTS.get(n, sum(LISTS.values(), []))}
    visual = corpus.chunks.filter(F.col("modality").isin(VISUAL)).select("chunk_id", "modality")
    q = corpus.embed(queries.select("query_id", "query"), "query").select("query_id", "vector")
    named = lambda df, name, modality, raw: df.select("query_id", F.lit(name).alias("list"), modality.alias("modality"), "chunk_id", "score", raw.alias("raw"), "rank")
    none, score = F.lit(None).cast("string"), F.col("score")
    out = named(R.dense(q, corpus.vectors, WIDEST), "dense", none, score)  # every strategy's
    if "sparse" in wanted:
        out = out.unionByName(named(R.bm25(queries, corpus.posts, corpus.idf, WIDEST), "sparse", none, F.col("raw")))
    if "visual" in wanted:
        out = out.unionByName(named(R.dense(q, corpus.vectors.filter(F.col("modality").isin(VISUAL)), WIDEST, part="modality"), "visual", F.col("modality"), score))
    if "visual_words" in wanted:
        out = out.unionByName(named(R.bm25(queries, corpus.posts, corpus.idf, WIDEST, visual, part=("modality",)), "visual_words", F.col("modality"), F.col("raw")))
    if corpus.hypothesis is not None and "hypothesis" in wanted:
        h = corpus.embed(corpus.hypothesis(queries).select("query_id", "query"), "query").select("query_id", "vector")
        out = out.unionByName(named(R.dense(h, corpus.vectors, WIDEST), "hypothesis", none, score))
    return stored(out, "searches")


def _list(cfg: DataFrame, found: DataFrame, name: str, number: int, most: Column, weight: Column | float = 1.0) -> DataFrame:
    """The first ``most`` of a search, as a list to fuse."""
    own = cfg.join(found.filter(F.col("list") == name), "query_id").filter(F.col("rank") <= most)
    return own.select("query_id", F.lit(name).alias("strategy"), F.lit(number).alias("list_no"), "rank", "chunk_id", "score", (weight if isinstance(weight, Column) else F.lit(weight)).cast("double").alias("weight"))


def _visual_list(cfg: DataFrame, found: DataFrame, name: str, number: int, weight: float) -> DataFrame:
    """The lists of the modalities that each query wants, merged by score."""
    wanted = F.when(F.size("modalities") > 0, F.col("modalities")).otherwise(X.lits(VISUAL))
    own = cfg.join(found.filter(F.col("list") == name), "query_id").filter(F.array_contains(wanted, F.col("modality")))
    w = Window.partitionBy("query_id")
    own = own.withColumn("score", F.when(F.lit(name == "visual"), F.col("raw")).otherwise(F.round(F.col("raw") / F.max("raw").over(w), 6)))
    own = own.withColumn("rank", F.row_number().over(w.orderBy(F.round("raw", 9).desc(), "chunk_id"))).filter(F.col("rank") <= F.least("pool", F.lit(POOL)))
    return own.select("query_id", F.lit(name).alias("strategy"), F.lit(number).alias("list_no"), "rank", "chunk_id", "score", F.lit(weight).alias("weight"))


def _dedup(fused: DataFrame, corpus: Corpus) -> DataFrame:
    # written: few rows that Spark sends to the texts, which are read once for them and not for each side of the comparison
    own = stored(fused, "fused").join(corpus.chunks.select("chunk_id", "document_id", "content"), "chunk_id")
    return R.deduplicate(stored(own, "fused_texts")).select(*NAMES)


def _front(cfg: DataFrame, ranked: DataFrame, kept: str | None = None) -> DataFrame:
    """The first ``top_k`` of each query, of those that the condition ``kept`` holds for."""
    own = ranked.join(cfg, "query_id")
    if kept is not None:
        own = own.filter(kept).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return own.filter(F.col("rank") <= F.col("top_k")).select(*NAMES)


#: What is left out of a list whose scores are comparable.
_ENOUGH = "score >= min_score"


def naive(cfg: DataFrame, found: DataFrame, corpus: Corpus) -> DataFrame:
    own = _list(cfg, found, "dense", 0, F.greatest(F.col("top_k"), F.least("pool", F.lit(POOL)))).withColumn("sources", F.array(F.lit("naive"))).select(*NAMES)
    return _front(cfg, own, _ENOUGH)


def hybrid(cfg: DataFrame, found: DataFrame, corpus: Corpus) -> DataFrame:
    pool = F.greatest(3 * F.col("top_k"), F.least("pool", F.lit(POOL)))
    lists = _list(cfg, found, "dense", 0, pool, F.col("dense_weight")).unionByName(_list(cfg, found, "sparse", 1, pool, F.col("sparse_weight")))
    return _front(cfg, _dedup(R.rrf(lists), corpus), _ENOUGH)


def hyde(cfg: DataFrame, found: DataFrame, corpus: Corpus) -> DataFrame:
    """Two dense probes, hypothesis .65 and question .35; without a hypothesis hook, the question alone."""
    if corpus.hypothesis is None:
        return naive(cfg, found, corpus).withColumn("sources", F.array(F.lit("hyde")))
    pool = F.greatest(F.col("top_k"), F.least("pool", F.lit(POOL)))
    lists = _list(cfg, found, "hypothesis", 0, pool, 0.65).unionByName(_list(cfg, found, "dense", 1, pool, 0.35))
    return _front(cfg, _dedup(R.rrf(lists), corpus))


def multimodal(cfg: DataFrame, found: DataFrame, corpus: Corpus) -> DataFrame:
    """Visual chunks by vectors 1.0 and words .6, all chunks by vectors .45."""
    lists = _visual_list(cfg, found, "visual", 0, 1.0).unionByName(_visual_list(cfg, found, "visual_words", 1, 0.6))
    lists = lists.unionByName(_list(cfg, found, "dense", 2, F.least("pool", F.lit(POOL)), 0.45))
    return _front(cfg, _dedup(R.rrf(lists), corpus))


def resolve_entities(cfg: DataFrame, corpus: Corpus, most: int = 8) -> DataFrame:
    """(query_id, key, nth): up to eight terms of a query with three matches each, or the query itself with six; the best connected ``most``."""
    a = A.analyze(cfg.select("query_id", "query"))
    terms = X.distinct_ignoring_case(F.filter(F.concat("entities", "key_terms", "terms"), lambda t: F.length(F.trim(t)) > 1))
    asked = a.select("query_id", F.when(F.size(terms) > 0, F.slice(terms, 1, 8)).otherwise(F.array("query")).alias("t"), F.when(F.size(terms) > 0, 3).otherwise(6).alias("most"))
    asked = asked.select("query_id", "most", F.posexplode("t").alias("pos", "query"))
    probe = asked.select(F.struct("query_id", "pos").alias("query_id"), "query")
    hits = G.search_entities(probe, corpus.nodes, 6).select("query_id.query_id", "query_id.pos", "key", "rank").join(asked.select("query_id", "pos", "most"), ["query_id", "pos"]).filter(F.col("rank") <= F.col("most"))
    hits = hits.groupBy("query_id", "key").agg(F.min(F.struct("pos", "rank")).alias("first")).join(G.degrees(corpus.nodes, corpus.edges), "key")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("degree").desc(), "first", "key"))
    return hits.withColumn("nth", nth).filter(F.col("nth") <= most).select("query_id", "key", "nth")


def graph(cfg: DataFrame, found: DataFrame, corpus: Corpus) -> DataFrame:
    """Chunks on paths around and between a query's entities and chunks that mention them, fused with a dense list at .5.

    Paths run from the best connected entity to the next three, and around all of them; a query without entities or
    evidence gets the dense list alone."""
    cfg = cfg.withColumn("depth", F.greatest(F.lit(1), F.least("depth", F.lit(4))))
    seeds = stored(resolve_entities(cfg, corpus), "seeds").join(cfg.select("query_id", "depth", "pool"), "query_id")
    first = seeds.filter("nth = 1").select("query_id", F.col("key").alias("src"))
    pairs = first.join(seeds.filter("nth between 2 and 4").select("query_id", F.col("key").alias("dst"), F.greatest("depth", F.lit(3)).alias("depth")), "query_id")
    between = stored(G.paths_between(pairs.select("src", "dst", "depth"), corpus.edges, 4), "paths")
    between = pairs.select("query_id", "src", "dst").join(between, ["src", "dst"])
    joined = between.select("query_id").distinct().withColumn("joined", F.lit(True))
    # with paths between entities the surroundings add up to 40 paths, without them up to 60
    starts = seeds.join(joined, "query_id", "left").select("query_id", "key", "depth", F.when(F.col("joined"), 40).otherwise(60).alias("limit"))
    around = G.neighborhood(starts, corpus.edges, 4, per="query_id")
    paths = between.select("query_id", "chunks", "score", F.lit(0).alias("kind"), F.row_number().over(Window.partitionBy("query_id").orderBy("hops", "path")).alias("n")).unionByName(around.select("query_id", "chunks", "score", F.lit(1).alias("kind"), F.col("rank").alias("n")))
    paths = paths.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("kind", "n"))).filter("n <= 80")
    on_path = paths.select("query_id", F.explode("chunks").alias("chunk_id"), F.col("score").alias("s"))
    mention = seeds.join(corpus.nodes.select("key", F.slice("chunk_ids", 1, 6).alias("c")), "key").select("query_id", F.explode("c").alias("chunk_id"), F.lit(None).cast("double").alias("s"))
    best = on_path.unionByName(mention).filter("chunk_id is not null").groupBy("query_id", "chunk_id").agg(F.coalesce(F.max("s"), F.lit(0.55)).alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))).join(cfg.select("query_id", "pool"), "query_id").filter(F.col("rank") <= F.col("pool"))
    lists = ranked.select("query_id", F.lit("graph").alias("strategy"), F.lit(0).alias("list_no"), "rank", "chunk_id", "score", F.lit(1.0).alias("weight"))
    half = F.greatest(F.col("top_k"), F.floor(F.col("pool") / 2))
    dense = _list(cfg, found, "dense", 1, half, 0.5)
    some = lists.select("query_id").distinct()
    fused = _dedup(R.rrf(lists.unionByName(dense.join(some, "query_id", "left_semi"))), corpus)
    alone = dense.join(some, "query_id", "left_anti").withColumn("sources", F.array(F.lit("dense"))).select(*NAMES)
    return _front(cfg, fused.unionByName(alone))


REGISTRY: dict[str, Callable[[DataFrame, DataFrame, Corpus], DataFrame]] = {"naive": naive, "hybrid": hybrid, "hyde": hyde, "multimodal": multimodal, "graph": graph}


def run_selected(cfg: DataFrame, found: DataFrame, corpus: Corpus) -> DataFrame:
    """Each query by the strategy that its column ``strategy`` names; only strategies that some query names run."""
    out = None
    for name in sorted(r[0] for r in cfg.select("strategy").distinct().collect()):  # at most as many as REGISTRY
        part = REGISTRY[name](cfg.filter(F.col("strategy") == name), found, corpus).select(*NAMES)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else found.select("query_id", "chunk_id", "score", "rank", F.array().cast("array<string>").alias("sources")).limit(0)


#: What each diagnosis changes: factor of the pool, more results, whether the least score goes.
REPAIRS = {"empty": (2.0, 0, True), "off_topic": (1.0, 0, True), "too_general": (1.75, 4, False), "wrong_document": (1.0, 0, True), "partially_relevant": (1.5, 0, False)}
#: Fixed value: most rounds of repair.
ROUNDS = 2


def repaired(cfg: DataFrame) -> DataFrame:
    """``cfg`` (with ``diagnosis``) with the settings that the diagnosis calls for."""
    pick = lambda i: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in REPAIRS.items() for x in (k, v[i]))), F.col("diagnosis")), F.lit(REPAIRS["partially_relevant"][i]))
    return cfg.withColumns({"pool": F.floor(F.col("pool") * pick(0)).cast("int"), "top_k": F.col("top_k") + pick(1), "min_score": F.when(pick(2), 0.0).otherwise(F.col("min_score")), "modalities": F.when(F.col("diagnosis") == "empty", F.array().cast("array<string>")).otherwise(F.col("modalities"))})


def correct(cfg: DataFrame, found: DataFrame, corpus: Corpus, floor: float = 0.45, names: list[str] | None = None) -> DataFrame:
    """The base result of each query (column ``strategy``), repaired where it is graded poor.

    Rewrites of poor queries run through the base strategy with the settings of their diagnosis and are fused with the
    result so far, original .7 and rewrites 1.0, without near-duplicates; graded again for a second round. A poor query without rewrites
    keeps its result. ``names`` are the strategies of ``cfg``, if they are known."""
    content = corpus.chunks.select("chunk_id", "content")
    now, open_, done = stored(run_selected(cfg, found, corpus), "base"), cfg, None
    for number in range(ROUNDS):
        poor = V.grade(open_.select("query_id", "query"), now.join(content, "chunk_id"), floor).filter(F.col("diagnosis") != "good").select("query_id", "diagnosis")
        asked = open_.select("query_id", "query").join(poor, "query_id")
        again = corpus.rewrites(asked) if corpus.rewrites else A.heuristic_rewrites(asked)
        again = stored(again.join(poor, "query_id").withColumn("own_id", F.concat_ws(":", "n", "query_id")), f"rewrites{number}")
        good = now.join(again, "query_id", "left_anti")
        done = good if done is None else done.unionByName(good)
        if again.isEmpty():
            return done
        mine = again.join(open_.drop("query"), "query_id").select(F.col("own_id").alias("query_id"), F.col("rewrite").alias("query"), "diagnosis", *(c for c in cfg.columns if c not in ("query_id", "query")))
        retried = stored(run_selected(repaired(mine), searches(mine, corpus, *([names] if names else [])), corpus), "retries").withColumnRenamed("query_id", "own_id").join(again.select("own_id", "query_id", "n"), "own_id")
        lists = now.join(again, "query_id", "left_semi").select("query_id", F.lit("original").alias("strategy"), F.lit(0).alias("list_no"), "rank", "chunk_id", "score", F.lit(0.7).alias("weight"))
        lists = lists.unionByName(retried.select("query_id", F.concat(F.lit("rewrite "), F.col("n").cast("string")).alias("strategy"), (F.col("n") + 1).alias("list_no"), "rank", "chunk_id", "score", F.lit(1.0).alias("weight")))
        open_ = open_.join(again, "query_id", "left_semi")
        now = stored(_front(open_, _dedup(R.rrf(lists), corpus)), f"round{number}")
    return done.unionByName(now)


def rerank(cfg: DataFrame, ranked: DataFrame, corpus: Corpus) -> DataFrame:
    """Heuristic rerank of the queries whose ``rerank`` holds, then a judge's blend where there is one; the first ``top_k``."""
    full = ranked.join(corpus.chunks, "chunk_id").join(corpus.ordinals.select("chunk_id", "ordinal"), "chunk_id").join(cfg.select("query_id", "query", "rerank", "modalities"), "query_id").withColumn("n_sources", F.size("sources"))
    new = R.heuristic_rerank(full, F.col("modalities"), F.col("rerank")).select(*NAMES)
    if corpus.judge is not None:
        new = R.blend_judged(new, corpus.judge(cfg.select("query_id", "query"), new))
    return _front(cfg, new)


def corrective(queries: DataFrame, corpus: Corpus, config: Config = Config(), base: str = "hybrid") -> DataFrame:
    """``correct`` over one base strategy, reranked at the end."""
    cfg = stored(settings(queries, config).withColumn("strategy", F.lit(base)), "settings")
    return rerank(cfg, correct(cfg, searches(queries, corpus, [base]), corpus, config.floor, [base]), corpus)


# What each tool of a plan runs, the most steps, and the words of a finding and of a hint.
TOOLS = {"dense_search": "naive", "hybrid_search": "hybrid", "graph_search": "graph", "multimodal_search": "multimodal", "hyde_search": "hyde"}
MOST_STEPS, FINDING_WORDS, HINT_WORDS = 6, 60, 40
STEP = "step int, sub_question string, tool string, depends_on array<int>"


def plan_steps(cfg: DataFrame, sub_questions: DataFrame | None = None) -> DataFrame:
    """The plan without a planner: (query_id, step, sub_question, tool, depends_on). Up to three ``sub_questions`` (query_id, sub_questions) are
    a hybrid step each; a query without them is a hybrid step itself, and a graph step if it asks for relations or chained facts."""
    a = A.analyze(cfg.select("query_id", "query")).select("query_id", "query", (F.col("relationship_query") | F.col("multi_hop")).alias("chained"))
    none = F.array().cast("array<string>")
    a = a.join(sub_questions.select("query_id", F.slice("sub_questions", 1, 3).alias("subs")), "query_id", "left") if sub_questions is not None else a.withColumn("subs", none)
    step = lambda n, text, tool: F.struct(n.cast("int").alias("step"), text.alias("sub_question"), F.lit(tool).alias("tool"), F.array().cast("array<int>").alias("depends_on"))
    plain = F.concat(F.array(step(F.lit(1), F.col("query"), "hybrid_search")), F.filter(F.array(step(F.lit(2), F.col("query"), "graph_search")), lambda s: F.col("chained")))
    asked = F.transform("subs", lambda x, i: step(i + 1, x, "hybrid_search"))
    return a.select("query_id", F.explode(F.when(F.size(F.coalesce("subs", none)) > 0, asked).otherwise(plain)).alias("s")).select("query_id", "s.*")


def checked_plan(cfg: DataFrame, planned: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """A planner's steps (query_id, step, sub_question, tool, depends_on) as far as they can be used: the first ``most``, an unknown tool is a hybrid search, and
    a step depends on earlier ones only. Queries left without a step get the plan of ``plan_steps``."""
    own = planned.filter((F.trim("sub_question") != "") & (F.col("step") <= most)).withColumn("tool", F.when(F.lower(F.trim("tool")).isin(*TOOLS), F.lower(F.trim("tool"))).otherwise("hybrid_search"))
    own = own.withColumn("depends_on", F.array_distinct(F.filter(F.coalesce("depends_on", F.array().cast("array<int>")), lambda d: d < F.col("step"))))
    own = own.select("query_id", "step", F.trim("sub_question").alias("sub_question"), "tool", "depends_on").join(cfg.select("query_id"), "query_id", "left_semi")
    return own.unionByName(plan_steps(cfg.join(own.select("query_id"), "query_id", "left_anti")))


def ready_steps(pending: DataFrame, done: DataFrame | None) -> DataFrame:
    """The pending steps whose dependencies are all done; of a query without one, its first pending step, which breaks a cycle or a dependency on nothing."""
    if done is None:
        open_ = pending.withColumn("waits", F.size("depends_on") > 0)
    else:
        finished = done.groupBy("query_id").agg(F.collect_set("step").alias("finished"))  # at most as many as a plan has steps
        open_ = pending.join(finished, "query_id", "left").withColumn("waits", F.size(F.array_except("depends_on", F.coalesce("finished", F.array().cast("array<int>")))) > 0).drop("finished")
    w = Window.partitionBy("query_id")
    stuck = F.min(F.col("waits").cast("int")).over(w) == 1
    first = F.min("step").over(w) == F.col("step")
    return open_.withColumns({"stuck": stuck, "first": first}).filter(~F.col("waits") | (F.col("stuck") & F.col("first"))).drop("waits", "stuck", "first")


def run_steps(cfg: DataFrame, ready: DataFrame, done: DataFrame | None, found: DataFrame, corpus: Corpus, floor: float) -> tuple[DataFrame, DataFrame]:
    """The steps of one wave: (results of each step: query_id, step, chunk_id, score, rank), (the steps with asked, chunks_found, top_score, quality, finding).

    What earlier steps found follows the question of a step that depends on them. Steps that ask the query itself take its lists from ``found``."""
    steps = ready.join(cfg.select("query_id", "query"), "query_id").withColumn("own_id", F.concat_ws(":", "step", F.col("query_id").cast("string")))
    hint = None
    if done is not None:
        told = steps.select("query_id", "own_id", F.posexplode("depends_on").alias("pos", "d")).join(done.select("query_id", F.col("step").alias("d"), "finding"), ["query_id", "d"])
        hint = told.filter("finding <> ''").groupBy("own_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "finding"))), lambda x: x["finding"]), " ").alias("hint"))
        steps = steps.join(hint, "own_id", "left")
    else:
        steps = steps.withColumn("hint", F.lit(None).cast("string"))
    asked = F.when(F.col("hint").isNotNull(), F.concat("sub_question", F.lit(" (context: "), X.truncate_words("hint", HINT_WORDS), F.lit(")"))).otherwise(F.col("sub_question"))
    steps = stored(steps.withColumn("asked", asked).drop("hint"), "wave")
    own = steps.join(cfg.drop("query", "strategy"), "query_id").withColumns({
        "top_k": F.greatest(F.lit(4), F.floor(F.col("top_k") / 2).cast("int")), "rerank": F.lit(False),
        "strategy": F.element_at(F.create_map(*(F.lit(x) for kv in TOOLS.items() for x in kv)), F.col("tool")),
    })
    own = own.select(F.col("own_id").alias("query_id"), F.col("asked").alias("query"), *(c for c in own.columns if c in cfg.columns and c not in ("query_id", "query")), *(["strategy"] if "strategy" not in cfg.columns else []))
    new = steps.filter(F.col("asked") != F.col("query"))
    lists = found.join(steps.filter(F.col("asked") == F.col("query")).select("query_id", "own_id"), "query_id").drop("query_id").withColumnRenamed("own_id", "query_id").select(*found.columns)
    if not new.isEmpty():
        lists = lists.unionByName(searches(new.select(F.col("own_id").alias("query_id"), F.col("asked").alias("query")), corpus))
    results = stored(run_selected(own, lists, corpus), "step_results")
    full = results.join(corpus.chunks.select("chunk_id", "content"), "chunk_id")
    quality = V.grade(steps.select(F.col("own_id").alias("query_id"), F.col("sub_question").alias("query")), full, floor).select(F.col("query_id").alias("own_id"), F.col("overall").alias("quality"))
    top = full.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks_found"), F.max("score").alias("top_score"), X.truncate_words(F.min_by("content", "rank"), FINDING_WORDS).alias("finding")).withColumnRenamed("query_id", "own_id")
    ran = steps.join(quality, "own_id", "left").join(top, "own_id", "left").withColumns({"chunks_found": F.coalesce("chunks_found", F.lit(0)).cast("long"), "top_score": F.coalesce("top_score", F.lit(0.0)), "quality": F.coalesce("quality", F.lit(0.0)), "finding": F.coalesce("finding", F.lit(""))})
    ids = steps.select("own_id", F.col("query_id").alias("of"), "step")
    hits = results.join(ids, F.col("query_id") == F.col("own_id")).select(F.col("of").alias("query_id"), "step", "chunk_id", "score", "rank")
    return hits, stored(ran.drop("own_id", "query"), "steps_done")


def run_waves(cfg: DataFrame, steps: DataFrame, found: DataFrame, corpus: Corpus, floor: float = 0.45, most: int = MOST_STEPS) -> tuple[DataFrame, DataFrame]:
    """All steps of all plans, wave by wave: a wave holds every step whose dependencies are done, of all queries at once."""
    pending, done, hits = stored(steps, "plan"), None, None
    for _ in range(most + 2):
        ready = stored(ready_steps(pending, done), "ready")
        if ready.isEmpty():
            break
        own, ran = run_steps(cfg, ready, done, found, corpus, floor)
        hits = own if hits is None else hits.unionByName(own)
        done = ran if done is None else done.unionByName(ran)
        pending = stored(pending.join(ready, ["query_id", "step"], "left_anti"), "plan")
    return hits, done


def _fuse_steps(hits: DataFrame, done: DataFrame | None, corpus: Corpus) -> DataFrame:
    """The steps' results fused without near-duplicates; weighted .6 + .6 of their quality where ``done`` is given, else alike."""
    weight = done.select("query_id", "step", (0.6 + 0.6 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("quality")))).alias("weight")) if done is not None else None
    own = hits.join(weight, ["query_id", "step"]) if weight is not None else hits.withColumn("weight", F.lit(1.0))
    return _dedup(R.rrf(own.select("query_id", F.concat(F.lit("step_"), F.col("step").cast("string")).alias("strategy"), F.col("step").alias("list_no"), "rank", "chunk_id", "score", "weight")), corpus)


def act(cfg: DataFrame, found: DataFrame, corpus: Corpus, floor: float = 0.45, most: int = MOST_STEPS) -> DataFrame:
    return act_with_steps(cfg, found, corpus, floor, most)[0]


def act_with_steps(cfg: DataFrame, found: DataFrame, corpus: Corpus, floor: float = 0.45, most: int = MOST_STEPS) -> tuple[DataFrame, DataFrame]:
    """Plan, run the plan in waves, reflect, fuse and rerank: (results, executed steps).

    Where the hook ``reflect`` finds the evidence insufficient and names a next query, one more step runs, if the plan had fewer than ``most``."""
    steps = checked_plan(cfg, corpus.planner(cfg.select("query_id", "query")), most) if corpus.planner else plan_steps(cfg)
    hits, done = run_waves(cfg, steps, found, corpus, floor, most)
    if hits is None:
        empty = cfg.join(found, "query_id").select("query_id", "chunk_id", "score", "rank", F.array().cast("array<string>").alias("sources")).limit(0)
        return empty, steps.limit(0)
    if corpus.reflect:
        seen = stored(_fuse_steps(hits, None, corpus), "interim")
        said = corpus.reflect(cfg.select("query_id", "query"), done, seen).filter(~F.col("sufficient") & (F.trim("next_query") != ""))
        ran = done.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < most)
        tool = F.when(F.lower("next_tool").isin(*TOOLS), F.lower("next_tool")).otherwise("hybrid_search")
        more = said.join(ran, "query_id").select("query_id", (F.col("n") + 1).cast("int").alias("step"), F.substring("next_query", 1, 400).alias("sub_question"), tool.alias("tool"), F.array().cast("array<int>").alias("depends_on"))
        more = stored(more, "follow_up")
        if not more.isEmpty():
            own, ran = run_steps(cfg, more, done, found, corpus, floor)
            hits, done = hits.unionByName(own), done.unionByName(ran)
    return rerank(cfg, _fuse_steps(hits, done, corpus), corpus), done


def agentic(queries: DataFrame, corpus: Corpus, config: Config = Config()) -> DataFrame:
    cfg = stored(settings(queries, config), "settings")
    return act(cfg, searches(queries, corpus), corpus, config.floor)


def routed_settings(queries: DataFrame, corpus: Corpus, config: Config = Config(), overrides: dict | None = None, names: list[str] | None = None) -> DataFrame:
    """``settings`` as the router decides for each query, with strategy, parallel, use_corrective, use_agentic and max_per_document.

    ``names`` pins strategies instead; ``overrides`` are values that win over the router's."""
    documents = corpus.chunks.agg(F.count_distinct("document_id").alias("n")).first().n
    routed = A.route(A.analyze(queries), documents, corpus.nodes is not None and not corpus.nodes.isEmpty(), top_k=config.top_k, pool=config.pool)
    routed = A.apply_forced(routed, names) if names else routed.withColumn("parallels", F.filter(F.array("parallel"), lambda p: p.isNotNull()))
    routed = A.apply_overrides(routed, overrides or {})
    keyword = F.coalesce("sparse_weight", F.lit(config.sparse_weight))
    return routed.select(
        "query_id", "query", F.col("top_k").cast("int").alias("top_k"), F.col("candidate_pool").cast("int").alias("pool"), F.lit(config.min_score).alias("min_score"),
        F.when(F.col("sparse_weight").isNull(), F.lit(config.dense_weight)).otherwise(F.round(1 - keyword, 3)).alias("dense_weight"), keyword.alias("sparse_weight"),
        F.col("graph_depth").cast("int").alias("depth"), "rerank", F.when(F.col("strategy") == "multimodal", A.modalities(F.col("requires_visual"), F.col("requires_tabular"))).otherwise(F.array().cast("array<string>")).alias("modalities"),
        "strategy", "parallel", "parallels", "use_corrective", "use_agentic", F.col("max_per_document").cast("int").alias("max_per_document"),
    )


def adaptive(queries: DataFrame, corpus: Corpus, config: Config = Config(), overrides: dict | None = None, names: list[str] | None = None) -> DataFrame:
    """Analyze, route and run: agentic queries by their plan; others by their strategy, corrected where the router asks for it, and fused with the
    parallel ones (primary 1.0, parallel .7) where there are any; document diversity where it is set; rerank where it is on; ``top_k`` as routed."""
    cfg = stored(routed_settings(queries, corpus, config, overrides, names), "settings")
    found = searches(queries, corpus)
    single = cfg.filter(~F.col("use_agentic"))
    plain = run_selected(stored(single.filter(~F.col("use_corrective")), "plain"), found, corpus)
    mended = correct(stored(single.filter("use_corrective"), "mended"), found, corpus, config.floor)
    first = stored(plain.unionByName(mended), "primary")
    lists = None
    for number in range(single.agg(F.max(F.size("parallels"))).first()[0] or 0):  # at most as many as REGISTRY
        own = stored(single.withColumn("strategy", F.get("parallels", F.lit(number))).filter(F.col("strategy").isin(*REGISTRY)), "beside")
        part = stored(run_selected(own, found, corpus), "parallel").join(own.select("query_id", "strategy"), "query_id")
        part = part.select("query_id", "strategy", F.lit(number + 1).alias("list_no"), "rank", "chunk_id", "score", F.lit(0.7).alias("weight"))
        lists = part if lists is None else lists.unionByName(part)
    one = first
    if lists is not None:
        both = lists.select("query_id").distinct()
        main = first.join(both, "query_id", "left_semi").join(cfg.select("query_id", "strategy"), "query_id").select("query_id", "strategy", F.lit(0).alias("list_no"), "rank", "chunk_id", "score", F.lit(1.0).alias("weight"))
        one = _dedup(R.rrf(main.unionByName(lists)), corpus).unionByName(first.join(both, "query_id", "left_anti"))
    spread = one.join(single.select("query_id", "max_per_document"), "query_id").join(corpus.chunks.select("chunk_id", "document_id"), "chunk_id")
    out = rerank(single, R.diversify(spread, F.col("max_per_document")).select(*NAMES), corpus)
    return out.unionByName(act(stored(cfg.filter("use_agentic"), "agents"), found, corpus, config.floor))


def _plain(name: str, f: Callable) -> Callable:
    def strategy(queries: DataFrame, corpus: Corpus, config: Config = Config()) -> DataFrame:
        return f(stored(settings(queries, config), "settings"), searches(queries, corpus, [name]), corpus)

    return strategy


REGISTRY_ALL: dict[str, Callable] = {**{name: _plain(name, f) for name, f in REGISTRY.items()}, "corrective": corrective, "adaptive": adaptive, "agentic": agentic}
# What each strategy is called and needs, for a catalogue.
CATALOGUE = {name: {"strategy": name, "composite": name in ("corrective", "adaptive", "agentic"), "needs_graph": name in ("graph", "agentic"), "hooks": {"hyde": ["hypothesis"], "corrective": ["rewrites", "judge"], "adaptive": ["hypothesis", "rewrites", "judge"]}.get(name, [])} for name in REGISTRY_ALL}


def evaluate(queries: DataFrame, corpus: Corpus, labels: DataFrame, names: list[str], config: Config = Config()) -> DataFrame:
    """Ranking metrics of several strategies over one set of queries, against shared labels (query_id, item, gain)."""
    from lodestone.operators import metrics as M

    out = None
    for name in names:
        found = REGISTRY_ALL[name](queries, corpus, config).select("query_id", F.col("chunk_id").alias("item"), "rank")
        own = M.mean_metrics(M.ranking_metrics(found, labels, config.top_k).withColumn("strategy", F.lit(name)), ["strategy"])
        out = own if out is None else out.unionByName(own)
    return out
