"""The experiment protocol, extractions, benchmark files, document detail and traversal limits."""

import random

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import graph as G
from lodestone.operators import index as N
from lodestone.operators import ingest as I
from lodestone.plans import experiment as XP
from lodestone.plans import strategies as S
from lodestone.sources import parsers as P


def test_experiment_judges_a_pool_once_and_measures_all_alike(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"d{i}", f"{'good' if i % 2 else 'bad'} passage {i}", "text", 60) for i in range(8)], "chunk_id long, document_id string, content string, modality string, token_count int")
    corpus = S.Corpus(chunks, chunks.select("chunk_id", F.lit(9).alias("ordinal")), None, None, None)

    def found(ids):
        hits = spark.createDataFrame([(c, 1 - r / 10, r) for r, c in enumerate(ids, 1)], "chunk_id long, score double, rank int")
        return lambda queries, corpus, config: queries.filter("query_id < 3").select("query_id").join(hits, F.lit(True)).withColumn("sources", F.array(F.lit("x")))

    monkeypatch.setitem(S.REGISTRY_ALL, "one", found([1, 0, 3]))
    monkeypatch.setitem(S.REGISTRY_ALL, "two", found([0, 2, 5]))
    questions = spark.createDataFrame([(1, "q1", "a"), (2, "q2", "b"), (3, "unanswered", "b")], "query_id long, query string, category string")
    own = spark.createDataFrame([(2, 2)], "query_id long, chunk_id long")
    e = XP.run(questions, corpus, ["one", "two"], lambda r: {"relevant_ids": [i["id"] for i in r["items"] if i["text"].startswith("good")]}, own, k=3)
    labels = {(r.query_id, r.chunk_id): r.relevant for r in e.labels.collect()}
    assert labels == {(1, 1): True, (1, 0): False, (1, 3): True, (1, 2): False, (1, 5): True, (2, 2): True}  # question 2 has labels of its own
    per = {(r.strategy, r.query_id): r for r in e.per_question.collect()}
    assert set(per) == {(s, q) for s in ("one", "two") for q in (1, 2)} and per["one", 1].category == "a"
    assert (per["one", 1].recall, per["one", 1].precision, per["one", 1].reciprocal_rank) == (0.666667, 0.666667, 1.0) and (per["two", 1].recall, per["two", 1].reciprocal_rank) == (0.333333, 0.333333)
    assert per["two", 2].recall == 1.0 and per["one", 2].hit == 0.0
    summary = {r.strategy: r for r in e.summary.collect()}
    assert (summary["one"].answered, summary["one"].labelled, summary["one"].asked, summary["one"].hit, summary["two"].hit) == (2, 2, 3, 0.5, 1.0) and {summary["one"].place, summary["two"].place} == {1, 2}
    bare = XP.run(questions, corpus, ["one"], k=3)
    assert all(not r.labelled and r.recall is None for r in bare.per_question.collect())


def test_extractions_that_hold(spark):
    entities = [("d", 1, " YOLO ", "model", 2.0, "x" * 600), ("d", 1, "NEU", None, None, None), ("d", 1, "the model", "MODEL", 0.1, ""), ("d", 1, "z" * 121, "MODEL", 0.1, ""), ("d", 2, "Far", "gadget", -1.0, ""), ("d", 1, None, "MODEL", 0.1, "")]
    relations = [("d", 1, "yolo", "neu", "trained on", 3.0), ("d", 1, "YOLO", "Far", "USES", 0.5), ("d", 1, "YOLO", "yolo", "USES", 0.5), ("d", 1, "NEU", "YOLO", "likes", None), ("d", 1, None, "YOLO", "USES", 0.5), ("d", 2, "YOLO", "NEU", "USES", 0.5)]
    e, r = I.valid_extractions(spark.createDataFrame(entities, "document_id string, chunk_id int, name string, entity_type string, salience double, description string"), spark.createDataFrame(relations, "document_id string, chunk_id int, source string, target string, relation_type string, confidence double"))
    assert {(x.key, x.entity_type, x.salience, len(x.description)) for x in e.collect()} == {("yolo", "MODEL", 1.0, 500), ("neu", "CONCEPT", 0.5, 0), ("far", "CONCEPT", 0.0, 0)}
    assert {(x.src, x.dst, x.relation_type, x.confidence) for x in r.collect()} == {("yolo", "neu", "TRAINED_ON", 1.0), ("neu", "yolo", "RELATED_TO", 0.5)}


def test_benchmarks_are_saved_listed_and_read(spark, tmp_path):
    q = spark.createDataFrame([("1", "What?", "fact"), ("2", "Why?", "cause"), ("3", "Who?", "fact")], "id string, question string, category string")
    P.save_benchmark(q.limit(1), str(tmp_path), "small")
    P.save_benchmark(q, str(tmp_path), "small", "2.0.0")
    P.save_benchmark(q, str(tmp_path), "other")
    assert sorted((r.name, r.version, r.questions, r.categories) for r in P.list_benchmarks(spark, str(tmp_path)).collect()) == [("other", "1.0.0", 3, 2), ("small", "2.0.0", 3, 2)]
    assert sorted(r.question for r in P.read_benchmark(spark, f"{tmp_path}/small").collect()) == ["What?", "Who?", "Why?"]


def test_document_detail_lists_entities_by_salience(spark):
    chunks = spark.createDataFrame([(1, "d", 2, "text"), (2, "d", 1, "table"), (3, "e", 1, "text")], "chunk_id long, document_id string, ordinal int, modality string")
    entities = spark.createDataFrame([("d", "low", 0.1, 9), ("d", "top", 0.9, 1), ("d", "mid b", 0.5, 2), ("d", "mid a", 0.5, 2)], "document_id string, key string, salience double, mentions long")
    index = N.Index(*[chunks] * 6)
    got = {r.document_id: (r.chunks, r.modalities, r.entities) for r in N.document_detail(index, entities, most_entities=3).collect()}
    assert got == {"d": ([2, 1], {"table": 1, "text": 1}, ["top", "mid a", "mid b"]), "e": ([3], {"text": 1}, None)}


def test_whole_numbers(spark):
    df = spark.createDataFrame([("3",), ("0",), ("-2",), ("2.9",), ("x",), (None,), ("1e3",)], "s string").select(X.at_least_one("s").alias("n"))
    assert [r.n for r in df.collect()] == [3, 1, 1, 2, 1, 1, 1000]


def test_a_hub_is_cut_to_what_is_wanted(spark):
    edges = [("a", f"n{i:03d}", "LINK", 0.9, 1, i, "d") for i in range(200)] + [(f"n{i:03d}", f"m{i:03d}", "LINK", 0.5, 1, i, "d") for i in range(200)]
    df = spark.createDataFrame(edges, "src string, dst string, type string, confidence double, weight long, chunk_id long, document_id string").withColumn("chunk_id", F.col("chunk_id").cast("string"))
    seeds = spark.createDataFrame([("a",), ("m007",)], "key string")
    got = G.neighborhood(seeds, df, 3, 20).collect()
    from_hub = sorted(tuple(r.path) for r in got if r.seed == "a")
    assert from_hub == [("a", f"n{i:03d}") for i in range(20)]
    assert sorted(len(r.path) for r in got if r.seed == "m007") == [2, 3, *[4] * 18]


def test_containment_meets_under_rare_runs(spark):
    r = random.Random(4)
    names = sorted({"neu " + "".join(r.choice("abcd") for _ in range(r.randrange(0, 5))) for _ in range(120)} | {"x", "ab", "zq"})
    nodes = spark.createDataFrame([(n.strip(), n.strip(), 1) for n in names], "key string, name string, mentions long").distinct()
    queries = ["neu ab", "NEU", "abcd", "what of neu abc and x", "zq", "b", ""]
    got = G.search_entities(spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"), nodes, 10_000).collect()
    keys = {n.strip() for n in names}
    for i, q in enumerate(queries):
        qk = " ".join(q.lower().split())
        contained = {k for k in keys if k and qk and (k in qk or qk in k)}
        assert contained <= {g.key for g in got if g.query_id == i}
