import pytest
from pyspark.sql import functions as F

from lodestone.operators import analyze as A
from lodestone.operators import graph as G
from lodestone.operators import ingest as I
from lodestone.operators import metrics as M
from lodestone.operators import retrieval as R
from lodestone.operators import verify as V
from lodestone.sources import parsers as P

QUESTIONS = [
    ("What optimizer was used?", "naive", False),
    ("Which model achieved the best result, and what data was that model trained on?", "graph", True),
    ('Find the exact term "NEU-DET" and its mAP value', "hybrid", False),
    ("What does Figure 2 show about accuracy?", "multimodal", False),
    ("How does DefectNet relate to the prior work it builds on?", "graph", False),
]


def test_routing_of_known_questions(spark):
    df = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(QUESTIONS)], "query_id int, query string")
    got = {r.query_id: r for r in A.route(A.analyze(df)).collect()}
    assert [(got[i].strategy, got[i].multi_hop) for i in range(len(QUESTIONS))] == [(s, m) for _, s, m in QUESTIONS]
    assert not got[0].rerank and got[2].sparse_weight >= 0.5 and got[4].reason.startswith("Selected graph")


@pytest.mark.parametrize(("text", "visual"), [("see Figure 3", True), ("revenue figures rose", False), ("graph database", False), ("show the image", True), ("the image", False), ("a pie chart", True)])
def test_visual_questions(spark, text, visual):
    assert spark.createDataFrame([(text,)], "q string").select(A.detect_visual(F.col("q")).alias("v")).first().v is visual


def test_forced_strategies():
    assert A.forced(["Corrective"]) == {"strategy": "naive", "parallel": [], "use_corrective": True, "use_agentic": False, "mode": "single", "rules_fired": ["explicit_strategy_override"]}
    assert A.forced(["hybrid", "graph", "nonsense"])["parallel"] == ["graph"]


def test_follow_ups_take_terms_of_earlier_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Tell me about YOLOv5s"), (1, 1, "assistant", "It is BERT"), (1, 2, "user", "and NEU-DET")], "conv_id int, turn int, role string, text string")
    latest = spark.createDataFrame([(1, "how fast is it?")], "conv_id int, query string")
    assert A.condense_history(turns, latest).first().condensed == "how fast is it? NEU-DET YOLOv5s"


def test_markdown_sections_and_code():
    blocks = P.text_blocks("# Title\n\n## Introduction\n\n### Background\ntext here\n\n## Results\nmore\n\n```\ncode\n```\n")
    assert [b["section_path"] for b in blocks if b["text"] in ("text here", "more")] == [["Title", "Introduction", "Background"], ["Title", "Results"]]
    assert [b["modality"] for b in blocks][-1] == "code"


def test_html_blocks():
    page = "<html><body><nav><p>menu text</p></nav><article><h1>Head</h1><p>first<p>second &amp; more</p><ul><li>item one<li>item two</ul><pre>code here</pre></article><p>outside text</p></body></html>"
    got = P.html_blocks(page)
    assert [b["text"] for b in got] == ["first", "second & more", "item one", "item two", "code here"] and got[0]["section_path"] == ["Head"] and got[-1]["modality"] == "code"


def block(text, path=("A",), modality="text", heading=None, order=0):
    return {"text": text, "section_path": list(path), "section": path[-1] if path else None, "modality": modality, "heading_level": heading, "block_order": order}


def chunks_of(spark, blocks, *how):
    rows = [("d", i, *(b[k] for k in ("text", "modality", "section", "section_path", "heading_level")), None) for i, b in enumerate(blocks)]
    return I.chunk(spark.createDataFrame(rows, P.BLOCKS), *how).orderBy("ordinal").collect()


def test_chunks_stay_in_sections_and_tables_stay_whole(spark):
    assert [c.section_path for c in chunks_of(spark, [block("one two three " * 5, ("A",)), block("four five six " * 5, ("B",))], 400, 60, 5)] == [["A"], ["B"]]
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    got = chunks_of(spark, [block("prose " * 20), block(table, modality="table"), block("more prose " * 20)], 200, 60, 5)
    assert [c.modality for c in got] == ["text", "table", "text"] and got[1].content == table
    long_ = "| a | b |\n| --- | --- |\n" + "\n".join(f"| row {i} with some text | y |" for i in range(60))
    got = chunks_of(spark, [block(long_, modality="table")], 40, 10, 5)
    assert len(got) > 3 and all(c.content.startswith("| a | b |\n| --- | --- |\n| row") for c in got) and sum(c.content.count("row ") for c in got) == 60


def test_long_prose_overlaps_and_small_blocks_merge(spark):
    got = [c.content for c in chunks_of(spark, [block(" ".join(f"Sentence number {i} has some words in it." for i in range(60)))], 100, 30, 10)]
    assert len(got) > 1 and all(set(a.split()[-8:]) & set(b.split()[:12]) for a, b in zip(got, got[1:], strict=False))
    assert len(chunks_of(spark, [block("tiny one"), block("tiny two"), block("tiny three")], 400, 60, 50)) == 1
    small = [block("word " * 90), block("heading", ("A",), heading=2), block("tail end")]
    assert [c.content for c in chunks_of(spark, small, 100, 30, 10)] == [("word " * 90).strip() + "\n\ntail end"]


def test_ranges_carry_over_what_fits():
    assert I.ranges([5, 5, 5, 5], 10, 5) == [(0, 2), (1, 3), (2, 4)] and I.ranges([50, 5], 10, 5) == [(0, 1), (1, 2)] and I.ranges([3, 50, 5], 10, 5) == [(0, 1), (0, 2), (2, 3)] and I.ranges([], 10, 0) == []


def test_chunking_documents(spark):
    files = spark.createDataFrame([("d1", "# T\n\nSome text.\n\nMore text."), ("d2", ""), ("d3", None)], "document_id string, content string")
    assert [(r.document_id, r.ordinal) for r in I.chunk(P.parse(files, P.text_blocks)).collect()] == [("d1", 1)]


EVIDENCE = [("a", "c1", "doc1", "DefectNet reaches 78.4 mAP on the NEU-DET benchmark for steel surface defects.", 0.9, 1, 2), ("a", "c2", "doc2", "Training used the AdamW optimizer with a cosine schedule over many epochs.", 0.8, 2, 1)]


def evidence(spark):
    return spark.createDataFrame(EVIDENCE, "answer_id string, chunk_id string, document_id string, content string, score double, rank int, n_sources int")


def answers(spark, text):
    return spark.createDataFrame([("a", text)], "answer_id string, answer string")


def test_claims_citations_and_numbers(spark):
    good = answers(spark, "DefectNet reaches 78.4 mAP on the NEU-DET benchmark [1]. Training used the AdamW optimizer with cosine schedule.")
    c = V.claims(good).orderBy("claim_index").collect()
    assert [list(x.cited) for x in c] == [[1], []] and c[0].claim_type == "numeric"
    assert V.citations(good, evidence(spark)).first().coverage == 0.5
    bad = V.verdicts(V.lexical_match(V.claims(answers(spark, "DefectNet reaches 91.2 mAP on the NEU-DET benchmark [9].")), evidence(spark))).first()
    assert not bad.numeric_ok and bad.support_score <= 0.35
    assert list(V.citations(answers(spark, "DefectNet reaches high scores on the benchmark [9]."), evidence(spark)).first().invalid) == [9]


def test_verification_accepts_and_abstains(spark):
    good = "DefectNet reaches 78.4 mAP on the NEU-DET benchmark for steel surface defects [1]."
    assert not V.verify(answers(spark, good), evidence(spark)).first().abstained
    assert V.verify(answers(spark, good), evidence(spark).limit(0)).first().abstained
    assert V.verify(answers(spark, "Bananas are yellow fruits that grow in warm tropical countries."), evidence(spark).withColumn("score", F.lit(0.12))).first().abstained


def test_bm25_counts_every_query_token(spark):
    chunks = spark.createDataFrame([(1, "red apple"), (2, "red red car"), (3, "blue sky"), (4, None), (5, "green"), (6, "grey")], "chunk_id int, content string")
    q = spark.createDataFrame([(1, "red car"), (2, "nothing")], "query_id int, query string")
    posts = R.postings(chunks)
    idf = R.term_idf(R.term_stats(posts))
    assert idf.select("avgdl").distinct().collect()[0][0] == 9 / 6
    got = R.bm25(q, posts, idf, 5).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, 2), (1, 1)] and got[0].score == 1.0


def test_greedy_dedup_keeps_what_only_a_dropped_chunk_matches(spark):
    words = [f"word{i}" for i in range(14)]
    texts = [" ".join(words[i : i + 10]) for i in (0, 1, 2)]
    rows = [(1, "d", i + 1, t, 0.9 - i / 10, i + 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id int, document_id string, chunk_id int, content string, score double, rank int")
    assert sorted(r.chunk_id for r in R.deduplicate(df, 0.88).collect()) == [1, 3]


def test_graph_merge_and_delete(spark):
    e = spark.createDataFrame([(1, "BERT", "CONCEPT", "", 0.4, "d1", "c1"), (2, "bert", "MODEL", "long text", 0.6, "d2", "c2"), (3, "SQuAD", "DATASET", "x", 0.5, "d1", "c1")], "seq int, name string, entity_type string, description string, salience double, document_id string, chunk_id string")
    nodes = G.merge_entities(e)
    n = {r.key: r for r in nodes.collect()}
    assert n["bert"].type == "MODEL" and n["bert"].mentions == 2 and n["bert"].name == "BERT" and n["bert"].description == "long text"
    r = spark.createDataFrame([(1, "BERT", "SQuAD", "USES", 0.5, "c1", "d1"), (2, "BERT", "SQuAD", "USES", 0.9, "c2", "d2"), (3, "BERT", "bert", "USES", 0.9, "c2", "d2"), (4, "BERT", "GPT", "USES", 0.9, "c2", "d2")], "seq int, source string, target string, relation_type string, confidence double, chunk_id string, document_id string")
    edges = G.merge_relations(r, nodes)
    (edge,) = edges.collect()
    assert (edge.confidence, edge.weight, edge.chunk_id) == (0.9, 2, "c1")
    left, kept = G.delete_document(nodes, edges, "d1")
    assert [x.key for x in left.collect()] == ["bert"] and kept.count() == 0


def test_percentiles_interpolate_and_empty_logs_give_zero(spark):
    log = spark.createDataFrame([("s", float(i), 1, 0.1, True, False) for i in range(1, 11)], "strategy string, latency_ms double, tokens int, cost double, corrective boolean, abstained boolean")
    assert M.system_metrics(log, ["strategy"]).first().p95_ms == 9.55
    empty = log.withColumns({"confidence": F.lit(0.5), "created_at": F.current_timestamp()}).limit(0)
    assert M.totals(empty, F.current_timestamp()).first().corrective_rate == 0.0


def test_metrics_without_labels_are_null(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "query_id int, item string, rank int")
    labels = spark.createDataFrame([(1, "b", 1.0), (1, "z", 1.0)], "query_id int, item string, gain double")
    got = {r.query_id: r for r in M.ranking_metrics(results, labels).collect()}
    assert (got[1].recall, got[1].precision, got[1].reciprocal_rank, got[1].hit) == (0.5, 0.5, 0.5, 1.0) and got[2].recall is None


def test_uploads(spark):
    rows = [("../../etc/a b.md", None, b"text", 4), ("x.exe", None, b"MZ", 2), ("a.pdf", None, b"nope", 4), ("a.pdf", "application/pdf", b"%PDF-", 5), ("a.txt", None, b"a\x00b", 3), ("a.txt", None, b"", 0), ("a.txt", "image/png", b"x", 1), ("a.txt", None, b"x", 1 << 40)]
    got = P.validate_uploads(spark.createDataFrame(rows, "filename string, content_type string, head binary, size long")).collect()
    assert got[0].safe_name == "a b.md" and [g.error for g in got] == [None, "type not accepted", "content differs", None, "binary content", "empty", "declared type differs", "too large"]


def test_reading_files_and_benchmarks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\ntext of the file")
    (tmp_path / "b.html").write_text("<p>paragraph</p>")
    assert sorted(r.text for r in P.parse_files(P.read_files(spark, str(tmp_path))).collect()) == ["A", "paragraph", "text of the file"]
    (tmp_path / "bench.json").write_text('{"name": "b", "questions": [{"id": "q1", "question": "x?", "category": "simple"}, {"id": "q2", "question": "y?", "category": "hop"}]}')
    q = P.read_benchmark(spark, str(tmp_path / "bench.json"))
    assert P.select_questions(q, ["hop"]).count() == 1 and P.benchmark_info(q).count() == 2


def test_streaming_windows_match_batch(spark, tmp_path):
    from lodestone.streaming.ingest import event_windows, landing

    rows = spark.range(200).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 300).alias("ts"), F.lit(1).alias("user_id"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/events")
    q = event_windows(stream).writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    batch = {(r.start, r.n) for r in event_windows(rows).collect()}
    got = {(r.start, r.n) for r in spark.table("windows").collect()}
    assert got and got <= batch
    assert landing(spark, str(tmp_path)).isStreaming


def test_graph_queries_without_sql_cover_the_whole_table(spark):
    from lodestone.plans import registry

    d = "/root/testdata/sf0.001"
    t = registry.Tables(spark, d)
    buys = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    _, edges = registry.graph_of(t)
    assert edges.agg(F.sum("weight")).first()[0] == buys.filter("c_nationkey <> s_nationkey").count() > 1000
    keys = {r.key for r in registry.graph_entities(spark, d).collect()}
    assert {(r.src, r.dst) for r in registry.graph_shortest(spark, d).select("src", "dst").distinct().collect()} == {(a, b) for a in keys for b in keys if a != b}
    assert {r.seed for r in registry.graph_paths_described(spark, d).select("seed").distinct().collect()} == keys
    assert {r.src for r in registry.graph_subgraph(spark, d).collect()} == keys


CHUNKS = "chunk_id long, document_id string, content string, modality string, token_count int"


def corpus_of(spark, rows, **more):
    from lodestone.plans import strategies as S

    chunks = spark.createDataFrame(rows, CHUNKS)
    return S.build(chunks, chunks.select("chunk_id", F.lit(9).alias("ordinal")), **more)


def test_corrective_repairs_twice_without_copies_and_reranks(spark, monkeypatch):
    from lodestone.plans import strategies as S

    words = " ".join(f"w{i}" for i in range(80))
    corpus = corpus_of(spark, [(1, "d1", words, "text", 100), (2, "d1", words, "text", 100), (3, "d2", "other things entirely " * 20, "text", 100)], with_graph=False)
    asked = []

    def stub(cfg, found, corpus):
        asked.append((cfg.select("min_score").first()[0], cfg.count()))
        hits = spark.createDataFrame([(1, 1), (2, 2), (3, 3)] if len(asked) > 1 else [], "chunk_id long, rank int")
        return cfg.select("query_id").join(hits, F.lit(True)).withColumns({"score": F.lit(0.5), "sources": F.array(F.lit("stub"))})

    monkeypatch.setitem(S.REGISTRY, "stub", stub)
    queries = spark.createDataFrame([(7, "What is the reported NEU-DET accuracy value of everything?")], "query_id int, query string")
    got = S.corrective(queries, corpus, base="stub").collect()
    assert len(asked) == 3 and asked[0] == (0.28, 1) and asked[1][0] == 0.0 and asked[1][1] > 1
    assert {r.chunk_id for r in got} == {1, 3} and [r.rank for r in sorted(got, key=lambda r: -r.score)] == [1, 2]
    assert max(r.score for r in got) < 1  # reranked: a fused list's best has 1


def test_routing_takes_effect(spark):
    from lodestone.plans import strategies as S

    text = lambda i: f"Passage {i} describes the optimizer NEU-DET used with value {i} and the AdamW schedule in section {i}. " + " ".join(f"word{(i * 7 + j) % 50}" for j in range(40))
    corpus = corpus_of(spark, [(i, f"d{i % 3}", text(i), "figure" if i % 5 == 0 else "text", 80) for i in range(30)])
    queries = spark.createDataFrame([(0, "What optimizer was used?"), (1, 'Find the exact term "NEU-DET" and its mAP value'), (2, "What does Figure 2 show about accuracy?"), (3, "How does AdamW relate to the NEU-DET schedule it builds on?"), (4, "Analyze the limitations of the optimizer across all documents, and compare how each study explains them, because which value was used and what does it imply?")], "query_id int, query string")
    cfg = {r.query_id: r for r in S.routed_settings(queries, corpus).collect()}
    assert [cfg[i].strategy for i in range(4)] == ["naive", "hybrid", "multimodal", "graph"] and (cfg[0].top_k, cfg[0].rerank) == (6, False)
    assert cfg[1].sparse_weight >= 0.5 and cfg[1].dense_weight == round(1 - cfg[1].sparse_weight, 3) and "figure" in cfg[2].modalities and cfg[4].use_agentic and cfg[4].top_k == 10
    rows = S.adaptive(queries, corpus).collect()
    by = {i: sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank) for i in range(5)}
    assert all([r.rank for r in v] == list(range(1, len(v) + 1)) and len(v) <= cfg[i].top_k for i, v in by.items())
    assert all(r.sources == ["naive"] for r in by[0]) and any("visual" in r.sources for r in by[2]) and any("graph" in r.sources for r in by[3])
    assert any("step_1" in r.sources for r in by[4])
    dense = R.truncate(R.dense(corpus.embed(queries, "query").select("query_id", "vector"), corpus.vectors, 40), 6).filter("query_id = 0 and score >= 0.28").collect()
    assert [(r.chunk_id, r.score) for r in by[0]] == [(r.chunk_id, r.score) for r in sorted(dense, key=lambda r: r.rank)]  # one strategy without rerank keeps its scores
    pinned = S.routed_settings(queries, corpus, overrides={"top_k": 3}, names=["hybrid", "graph"]).collect()
    assert all((r.strategy, r.parallel, r.top_k, r.use_agentic) == ("hybrid", "graph", 3, False) for r in pinned)


@pytest.mark.parametrize("block", [2048, 3])
def test_dense_search_is_exact_in_blocks_and_parts(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    r = np.random.default_rng(3)
    v = r.normal(size=(200, 8)).round(1)
    v[50:80] = v[50]
    df = spark.createDataFrame([(i, [float(x) for x in row], "ab"[i % 2]) for i, row in enumerate(v)], "chunk_id long, vector array<double>, kind string").repartition(5)
    q = df.filter("chunk_id < 7").select(F.col("chunk_id").alias("query_id"), "vector")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = (unit[:7] @ unit.T).round(6)
    for part in (None, "kind"):
        got = R.dense(q, df, 12, exclude_self=True, part=part).collect()
        for i in range(7):
            for k in "ab" if part else [None]:
                want = sorted((-s[i, j], j) for j in range(200) if j != i and (k is None or "ab"[j % 2] == k))[:12]
                mine = sorted((r.rank, r.chunk_id) for r in got if r.query_id == i and (k is None or r.kind == k))
                assert [c for _, c in mine] == [j for _, j in want]


INDEXED = "chunk_id long, document_id string, ordinal int, content string, modality string"


def test_index_upsert_delete_and_reload(spark, tmp_path):
    from lodestone.operators import index as N

    rows = [(1, "d1", 1, "YOLOv5s detects defects on NEU-DET", "text"), (2, "d1", 2, "plain words only", "text"), (3, "d2", 1, "NEU-DET has six classes", "table"), (4, "d3", 1, "", "text")]
    index = N.build(spark.createDataFrame(rows, INDEXED)).save(str(tmp_path / "one"))
    q = spark.createDataFrame([(1, "classes on NEU-DET")], "query_id int, query string")
    counts = lambda x: {r.part: r.n for r in x.counts().collect()}
    assert counts(index) == {"chunks": 4, "posts": 4, "vectors": 4, "nodes": 2, "edges": 1}
    assert [r.chunk_id for r in index.search(q, 5).orderBy("rank").collect()] == [3, 1]
    left = N.delete_documents(index, spark.createDataFrame([("d1",)], "document_id string"))
    assert counts(left) == {"chunks": 2, "posts": 2, "vectors": 2, "nodes": 1, "edges": 0}
    node = left.nodes.first()
    assert node.key == "neu det" and list(node.documents) == ["d2"] and {r.chunk_id for r in left.chunks.collect()} == {3, 4}
    new = spark.createDataFrame([(2, "d1", 2, "old", "text", 1), (2, "d1", 2, "classes everywhere", "text", 2), (5, "d4", 1, "NEU-DET again", "text", 1)], INDEXED + ", seq int")
    more = N.upsert(index, new)
    assert counts(more)["chunks"] == 5 and {r.chunk_id for r in more.search(q, 9).collect()} == {1, 2, 3, 5}
    assert more.chunks.filter("chunk_id = 2").first().content == "classes everywhere"
    assert {r.key: list(r.documents) for r in more.nodes.collect()}["neu det"] == ["d1", "d2", "d4"]
    swapped = N.replace_documents(index, spark.createDataFrame([(9, "d1", 1, "nothing of it", "text")], INDEXED))
    assert {r.chunk_id for r in swapped.chunks.collect()} == {3, 4, 9} and counts(swapped)["edges"] == 0


def test_answers_are_cleaned_or_withheld(spark):
    good = "DefectNet reaches 78.4 mAP on the NEU-DET benchmark for steel surface defects [1]. Training used the AdamW optimizer with a cosine schedule over many epochs [7]."
    r = V.verify(answers(spark, good), evidence(spark)).first()
    assert r.modified and "[7]" not in r.answer and "[1]" in r.answer and not r.abstained and r.reason is None
    none = V.verify(answers(spark, good), evidence(spark).limit(0)).first()
    assert none.abstained and none.reason == "no evidence" and none.answer.startswith(V.WITHHELD) and "78.4" not in none.answer
    weak = V.verify(answers(spark, "Bananas weigh 91.2 grams and grow in warm tropical countries everywhere."), evidence(spark).withColumn("score", F.lit(0.12))).first()
    assert weak.abstained and "91.2" not in weak.answer and weak.reason
    failed = V.verify(answers(spark, good).withColumn("error", F.lit("timeout")), evidence(spark)).first()
    assert failed.answer == good and failed.score is None and not failed.abstained and failed.reason == "error"


def test_traversal_limits_are_shared_and_exact(spark):
    edges = spark.createDataFrame([(a, b, "T", 0.5 + i / 100, f"c{i}", "d") for i, (a, b) in enumerate([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("h", "a")])], "src string, dst string, type string, confidence double, chunk_id string, document_id string")
    seeds = spark.createDataFrame([(1, "a"), (1, "e"), (2, "e")], "query_id int, key string")
    got = G.neighborhood(seeds, edges, 2, 5, per="query_id").collect()
    of = lambda i: sorted((r.hops, tuple(r.path)) for r in got if r.query_id == i)
    assert of(1) == [(1, ("a", "b")), (1, ("a", "c")), (1, ("a", "h")), (1, ("e", "d")), (2, ("a", "b", "d"))] and of(2) == [(1, ("e", "d")), (2, ("e", "d", "b")), (2, ("e", "d", "c"))]
    one = G.neighborhood(seeds.select("key").distinct(), edges, 2, 3).collect()
    assert max(r.hops for r in one if r.seed == "a") == 1  # three paths of one hop are enough
    paths = G.paths_between(spark.createDataFrame([("a", "e")], "src string, dst string"), edges, 3).orderBy("path").collect()
    assert [list(r.path) for r in paths] == [["a", "b", "d", "e"], ["a", "c", "d", "e"]] and list(paths[0].chunks) == ["c0", "c2", "c4"]


def test_parsers_by_extension_and_hooks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\ntext of the file")
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04binary")
    (tmp_path / "c.bin").write_text("left out")
    hook = lambda data: [P._block(1, f"{len(data)} bytes", "text", [])]
    assert sorted(r.text for r in P.parse_files(P.read_files(spark, str(tmp_path)), {".docx": hook}).collect()) == ["10 bytes", "A", "text of the file"]


def test_searches_of_the_index_compute_no_vectors_and_replace_in_one_pass(spark, monkeypatch):
    from lodestone.operators import index as N
    from lodestone.operators import ingest as I
    from lodestone.plans import registry as G

    @F.udf("array<float>")
    def fails(text):
        raise ValueError("no search needs the vectors")

    monkeypatch.setattr(I, "hash_embed", lambda df, *a: df.withColumn("vector", fails(df.columns[-1])))
    monkeypatch.setattr(G, "_built", {})
    written = []
    monkeypatch.setattr(N, "stored", lambda df, what, own=N.stored: written.append(what) or own(df, what))
    d = "/root/testdata/sf0.001"
    assert G.QUERIES["index_reindex"](spark, d).count() > 0 and written.count("gone") == 1
    assert G.QUERIES["index_upsert"](spark, d).count() > 0 and G.QUERIES["index_delete"](spark, d).count() > 0
    assert {r.part for r in G.QUERIES["index_counts"](spark, d).collect()} == {"chunks", "posts", "vectors"}


def test_strategies_compute_only_the_lists_and_indexes_that_they_read(spark, monkeypatch):
    from lodestone.plans import registry as G
    from lodestone.plans import strategies as S

    written = []
    for m in (S, R):
        monkeypatch.setattr(m, "stored", lambda df, what, own=m.stored: written.append(what) or own(df, what))
    monkeypatch.setattr(G, "_built", {})
    d = "/root/testdata/sf0.001"
    assert G.QUERIES["strategy_naive"](spark, d).count() > 0 and set(written) == {"vectors", "settings", "searches"}
    written.clear()
    assert G.QUERIES["strategy_naive_vectors"](spark, d).count() > 0 and "terms" not in written
    # fewer lists, the same results as over all of them
    corpus, questions = G.corpus_of(G.Tables(spark, d), [*S.PARTS]), G.questions_of(G.Tables(spark, d))
    cfg, every = S.settings(questions), S.searches(questions, corpus)
    for name in ("naive",):
        rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
        assert rows(S.REGISTRY_ALL[name](questions, corpus)) == rows(S.REGISTRY[name](cfg, every, corpus))
    assert {r.list for r in S.searches(questions, corpus, ["hybrid"]).select("list").distinct().collect()} == {"dense", "sparse"}
