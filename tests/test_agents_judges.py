"""Plans run in waves, judged batches, merged analyses, and the plan of a keyword search."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import analyze as A
from lodestone.operators import judge as J
from lodestone.operators import retrieval as R
from lodestone.operators import verify as V
from lodestone.plans import strategies as S

CHUNKS = "chunk_id long, document_id string, content string, modality string, token_count int"
STEPS = "query_id long, step int, sub_question string, tool string, depends_on array<int>"


@pytest.fixture
def stubbed(spark, monkeypatch):
    """A corpus whose searches are recorded and whose strategies find the chunks that the question's words name."""
    chunks = spark.createDataFrame([(i, f"d{i}", f"{w} is what this passage number {i} explains in words", "text", 60) for i, w in enumerate(["alpha", "beta", "gamma", "delta"])], CHUNKS)
    corpus = S.Corpus(chunks, chunks.select("chunk_id", F.lit(9).alias("ordinal")), None, None, None)
    asked = []

    def searches(queries, corpus):
        rows = [(r.query_id, r.query) for r in queries.select("query_id", "query").collect()]
        asked.append(dict(rows))
        return spark.createDataFrame([(str(i), "dense", None, 0, 1.0, 1.0, 1) for i, _ in rows], "query_id string, list string, modality string, chunk_id long, score double, raw double, rank int")

    def strategy(cfg, found, corpus):
        text = corpus.chunks.select("chunk_id", F.substring_index("content", " ", 1).alias("w"))
        hit = cfg.join(text, F.contains(F.lower("query"), F.col("w"))).join(found.select("query_id").distinct(), "query_id", "left_semi")
        rank = F.row_number().over(R.Window.partitionBy("query_id").orderBy("chunk_id"))
        return hit.select("query_id", "chunk_id", F.lit(0.9).alias("score"), rank.alias("rank"), F.array(F.lit("stub")).alias("sources"))

    monkeypatch.setattr(S, "searches", searches)
    for name in ("hybrid", "graph", "naive"):
        monkeypatch.setitem(S.REGISTRY, name, strategy)
    return corpus, asked


def found_of(spark, ids):
    return spark.createDataFrame([(i, "dense", None, 0, 1.0, 1.0, 1) for i in ids], "query_id long, list string, modality string, chunk_id long, score double, raw double, rank int")


def test_three_waves_pass_findings_on_and_a_cycle_is_broken(spark, stubbed):
    corpus, asked = stubbed
    plan = [
        (1, 1, "about alpha", "hybrid_search", []), (1, 2, "then beta", "dense_search", [1]), (1, 3, "and gamma", "nonsense", [1, 2]), (1, 7, "beyond the most", "hybrid_search", []),
        (2, 1, "delta first", "hybrid_search", [2]), (2, 2, "alpha later", "hybrid_search", [1]), (2, 3, " ", "hybrid_search", []), (3, 1, "nothing is found", "graph_search", None), (3, 2, "beta after nothing", "hybrid_search", [1]),
    ]
    queries = spark.createDataFrame([(1, "alpha beta gamma?"), (2, "cycle?"), (3, "empty?")], "query_id long, query string")
    cfg = S.settings(queries)
    steps = spark.createDataFrame(plan, STEPS)
    checked = {(r.query_id, r.step): r for r in S.checked_plan(cfg, steps).collect()}
    assert set(checked) == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2)} and checked[1, 3].tool == "hybrid_search" and checked[2, 1].depends_on == [] and checked[2, 2].depends_on == [1]
    raw = steps.filter("step < 7 and sub_question <> ' '").withColumns({"tool": F.lit("hybrid_search"), "depends_on": F.coalesce("depends_on", F.array().cast("array<int>"))})  # with its cycle
    hits, done = S.run_waves(cfg, raw, found_of(spark, [1, 2, 3]), corpus)
    assert [sorted(a) for a in asked] == [["1:1", "1:2", "1:3"], ["2:1", "2:2", "2:3"], ["3:1"]]
    assert asked[0] == {"1:1": "about alpha", "1:2": "delta first", "1:3": "nothing is found"}  # 2's first step breaks its cycle
    assert asked[1]["2:1"].startswith("then beta (context: alpha is what this passage number 0") and asked[1]["2:3"] == "beta after nothing"
    assert asked[2]["3:1"].startswith("and gamma (context: alpha is what") and "…" not in asked[1]["2:1"]
    ran = {(r.query_id, r.step): r for r in done.collect()}
    assert len(ran) == 7 and ran[3, 1].chunks_found == 0 and ran[3, 1].finding == "" and ran[1, 3].chunks_found == 2 and ran[2, 2].finding.startswith("alpha")
    assert {(r.query_id, r.step, r.chunk_id) for r in hits.collect()} >= {(1, 1, 0), (1, 2, 0), (1, 2, 1), (1, 3, 2), (2, 1, 3), (2, 2, 0), (3, 2, 1)}


def test_reflection_adds_one_step_and_quality_weighs(spark, stubbed):
    corpus, asked = stubbed
    corpus.reflect = lambda queries, done, seen: queries.join(done.groupBy("query_id").agg(F.max("step").alias("s")), "query_id").select("query_id", (F.col("query_id") == 2).alias("sufficient"), F.lit("what of delta?").alias("next_query"), F.lit("odd").alias("next_tool"))
    queries = spark.createDataFrame([(1, "about alpha?"), (2, "about beta?")], "query_id long, query string")
    got, done = S.act_with_steps(S.settings(queries), found_of(spark, [1, 2]), corpus)
    ran = {(r.query_id, r.step): r for r in done.collect()}
    assert set(ran) == {(1, 1), (2, 1), (1, 2)} and ran[1, 2].sub_question == "what of delta?" and ran[1, 2].tool == "hybrid_search"
    assert asked == [{"2:1": "what of delta?"}]  # the plans' own questions reuse the lists at hand
    by = {(r.query_id, r.chunk_id): r for r in got.collect()}
    assert set(by) == {(1, 0), (1, 3), (2, 1)} and by[1, 3].sources == ["step_2"]
    corpus.reflect = None
    assert S.act_with_steps(S.settings(queries), found_of(spark, [1, 2]), corpus, most=1)[1].count() == 2


def test_plan_without_planner(spark):
    queries = spark.createDataFrame([(1, "What is it?"), (2, "How does A relate to B?"), (3, "x")], "query_id long, query string")
    subs = spark.createDataFrame([(3, ["p", "q", "r", "s"])], "query_id long, sub_questions array<string>")
    got = sorted((r.query_id, r.step, r.sub_question, r.tool) for r in S.plan_steps(S.settings(queries), subs).collect())
    assert got == [(1, 1, "What is it?", "hybrid_search"), (2, 1, "How does A relate to B?", "hybrid_search"), (2, 2, "How does A relate to B?", "graph_search"), (3, 1, "p", "hybrid_search"), (3, 2, "q", "hybrid_search"), (3, 3, "r", "hybrid_search")]


def test_pinned_strategies_all_run(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"d{i}", f"passage {i} has words of its own like w{i} and v{i}", "text", 60) for i in range(4)], CHUNKS)
    corpus, ran = S.Corpus(chunks, chunks.select("chunk_id", F.lit(9).alias("ordinal")), None, None, None), []
    monkeypatch.setattr(S, "searches", lambda q, c: found_of(spark, [1]))
    for n, name in enumerate(("hybrid", "graph", "naive")):
        def stub(cfg, found, corpus, name=name, n=n):
            ran.append(name)
            return cfg.select("query_id", F.lit(n).cast("long").alias("chunk_id"), F.lit(0.9).alias("score"), F.lit(1).alias("rank"), F.array(F.lit(name)).alias("sources"))

        monkeypatch.setitem(S.REGISTRY, name, stub)
    queries = spark.createDataFrame([(1, "what?")], "query_id long, query string")
    got = S.adaptive(queries, corpus, names=["hybrid", "graph", "naive"]).collect()
    assert sorted(ran) == ["graph", "hybrid", "naive"] and {r.chunk_id for r in got} == {0, 1, 2}
    assert A.apply_forced(queries, ["graph", "naive", "hyde"]).first().parallels == ["naive", "hyde"]


def test_packs_and_answers(spark):
    rows = spark.createDataFrame([(q, i, f"t{i}") for q, n in ((1, 25), (2, 3)) for i in range(n)], "query_id long, rank int, text string")
    packs = J.pack(rows, ["query_id"], ["rank"], ["rank", "text"])
    assert sorted((r.query_id, r.pack, [i.rank for i in r["items"]]) for r in packs.collect()) == [(1, 0, list(range(12))), (1, 1, list(range(12, 24))), (1, 2, [24]), (2, 0, [0, 1, 2])]

    def hook(r):
        if r["pack"] == 1:
            raise RuntimeError("no model")
        return None if r["query_id"] == 2 else {"n": len(r["items"]), "first": r["items"][0]["text"], "more": 1} if r["pack"] == 0 else {"n": "many"}

    got = {(r.query_id, r.pack): (r.answer and (r.answer.n, r.answer.first), r.error) for r in J.ask(packs, hook, "n int, first string").collect()}
    assert got[1, 0] == ((12, "t0"), None) and got[2, 0] == (None, None) and got[1, 1] == (None, "RuntimeError: no model") and got[1, 2][0] is None and "ValueError" in got[1, 2][1]


def test_pool_is_judged_once_for_each_passage(spark):
    questions = spark.createDataFrame([(1, "red"), (2, "blue"), (3, "none")], "query_id long, query string")
    results = [(1, s, i, r, f"{'red' if i % 2 else 'blue'} {i}") for s, ids in (("a", range(20)), ("b", range(10, 30))) for r, i in enumerate(ids, 1)] + [(2, "a", 5, 1, "red 5")]
    calls = []

    def hook(r):
        return {"relevant_ids": [i["id"] for i in r["items"] if r["query"] in i["text"]] + ["999"]}

    got = J.judge_pool(questions, spark.createDataFrame(results, "query_id long, strategy string, chunk_id long, rank int, content string"), hook).collect()
    assert sorted((r.query_id, r.chunk_id, r.relevant) for r in got) == [*((1, i, i % 2 == 1) for i in range(20)), (2, 5, False)] and not calls
    broken = J.judge_pool(questions, spark.createDataFrame(results, "query_id long, strategy string, chunk_id long, rank int, content string"), lambda r: None).collect()
    assert len(broken) == 21 and all(r.relevant is None for r in broken)


def test_answer_judges(spark):
    answers = spark.createDataFrame([(1, "q", "an answer"), (2, "q", ""), (3, "q", "no evidence")], "answer_id long, query string, answer string")
    evidence = spark.createDataFrame([(1, 7, 2, "second"), (1, 8, 1, "first"), (2, 9, 1, "x")], "answer_id long, chunk_id long, rank int, content string")
    order = lambda r: {"score": 0.5 if [p["text"] for p in r["passages"]] == ["first", "second"] else 7}
    got = {r.answer_id: (r.faithfulness, r.answer_relevance, r.context_relevance) for r in J.judge_answers(answers, evidence, order, lambda r: {"score": float("nan")} if r["answer_id"] == 3 else {"score": -1}, lambda r: {}).collect()}
    assert got == {1: (0.5, 0.0, None), 2: (None, None, None), 3: (1.0, None, None)}


def test_only_borderline_grades_are_asked_about(spark):
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "nothing"), (4, "alpha"), (5, "beta")], "query_id long, query string")
    ranked = spark.createDataFrame([(q, c, s, k, t) for q, s in ((1, 0.95), (2, 0.5), (4, 0.5), (5, 0.5)) for k, (c, t) in enumerate([(1, "alpha beta"), (2, "other words")], 1)], "query_id long, chunk_id long, score double, rank int, content string")
    lexical = {r.query_id: (r.overall, r.diagnosis) for r in V.grade(queries, ranked).collect()}
    replies = {2: {"grades": [{"id": "1", "score": 3}, {"id": "2", "score": 0.4}], "diagnosis": "Wrong_Document"}, 4: {"grades": [{"id": "1", "score": 0.9}], "overall": 0.91, "diagnosis": "??"}, 5: {"grades": [], "overall": 1.0}}
    near = {q for q, (o, d) in lexical.items() if abs(o - 0.45) < 0.22 and d != "empty"}
    got = {r.query_id: (r.overall, r.diagnosis, r.method) for r in J.grade_borderline(queries, ranked, lambda r: replies[r["query_id"]]).collect()}
    assert near >= {2, 4} and 3 not in near
    for q, (o, d) in lexical.items():
        want = {2: (0.7, "wrong_document", "lexical+judge"), 4: (0.91, "good", "lexical+judge")}.get(q, (o, d, "lexical")) if q in near else (o, d, "lexical")
        assert got[q] == want


def test_model_claims_fall_back_on_sentences(spark):
    own = "The measured accuracy of the model is 76 percent [1]. It was trained on steel images only [2]."
    answers = spark.createDataFrame([(1, own), (2, own), (3, "Insufficient evidence found in the indexed knowledge base."), (4, None)], "answer_id long, answer string")
    reply = {1: {"claims": [{"text": "  A claim that is long enough [3] ", "cited": [3, None]}, {"text": "short"}, {"text": "Another claim of some length", "type": "causal"}]}, 2: {"claims": [{"text": "short"}]}}
    got = sorted((r.answer_id, r.claim_index, r.claim, r.method) for r in J.claims(answers, lambda r: reply[r["answer_id"]]).collect())
    lexical = V.claims(answers.filter("answer_id = 2")).count()
    assert lexical and [g[:2] for g in got] == [(1, 0), (1, 1), *((2, i) for i in range(lexical))] and got[0][2] == "A claim that is long enough" and {g[3] for g in got[:2]} == {"judge"} and {g[3] for g in got[2:]} == {"lexical"}


def test_merged_analysis_has_all_fields(spark):
    queries = A.analyze(spark.createDataFrame([(1, "What is the NEU-DET accuracy?"), (2, "x")], "query_id long, query string"))
    schema = "query_id long, intent string, complexity string, multi_hop boolean, requires_tabular boolean, cross_document boolean, ambiguity double, expected_documents int, entities array<string>, key_terms array<string>, sub_questions array<string>, reasoning string"
    judged = spark.createDataFrame([(1, "Comparison", "COMPLEX", None, True, True, 0.99, 5, ["neu-det", "YOLO"], None, [" a ", "", None, *"bcdefg"], " because ")], schema)
    own, got = {r.query_id: r for r in queries.collect()}, {r.query_id: r for r in A.merge_judgement(queries, judged).collect()}
    g = got[1]
    assert (g.intent, g.complexity, g.multi_hop, g.requires_tabular, g.cross_document, g.ambiguity, g.expected_documents) == ("comparison", "complex", own[1].multi_hop, True, True, 0.99, 5)
    assert g.entities == ["NEU-DET", "YOLO"] and g.key_terms == own[1].key_terms and g.sub_questions == ["a", *"bcdef"] and g.reasoning == "because"
    assert got[2].asDict() == own[2].asDict() | {"sub_questions": [], "reasoning": None}
    odd = spark.createDataFrame([(1, "what", "huge")], "query_id long, intent string, complexity string")
    assert {r.query_id: (r.intent, r.complexity) for r in A.merge_judgement(queries, odd).collect()} == {i: (r.intent, r.complexity) for i, r in own.items()}


def test_keyword_search_sends_terms_and_not_postings_to_the_tasks(spark):
    from lodestone.plans import registry

    t = registry.Tables(spark, "/root/testdata/sf0.001")
    plan = R.bm25(registry.questions_of(t), t.postings, t.idf, 20)._jdf.queryExecution().executedPlan().toString()
    assert "terms-" in plan.replace("lodestone-terms", "terms-") or "BroadcastHashJoin" in plan
    side = plan[plan.index("BroadcastExchange") :] if "BroadcastExchange" in plan else ""
    assert "posexplode" not in plan and "regexp_extract_all" not in plan and "lodestone-postings" not in side[: side.find("\n", side.find("FileScan"))]
