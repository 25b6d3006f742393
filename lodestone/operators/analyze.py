"""Query analysis and routing: projections over the table of queries, without any join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lexicons as L
from lodestone.functions import text as X


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def detect_visual(query: Column) -> Column:
    """A figure reference; not a non-visual use; a strong marker; two weak ones, or one with a verb of showing."""
    low = F.lower(query)
    weak = X.count_of(low, L.WEAK_VISUAL)
    return (
        F.when(F.rlike(query, F.lit(L.FIGURE_REFERENCE)), True)
        .when(F.rlike(query, F.lit(L.NOT_VISUAL)), False)
        .when(X.has_any(low, L.STRONG_VISUAL), True)
        .otherwise((weak >= 2) | ((weak >= 1) & F.rlike(low, F.lit(L.SHOWING))))
    )


def analyze(queries: DataFrame, query: str = "query") -> DataFrame:
    """``queries`` with the features that routing needs."""
    q = F.col(query)
    low = F.lower(q)
    d = queries.withColumns({
        "word_count": F.size(X.tokenize(q, content=False)),
        "terms": X.technical_terms(q),
        "quoted": X.quoted_phrases(q),
        "n_tokens": F.size(X.tokenize(q)),
        "requires_visual": detect_visual(q),
        "requires_tabular": X.has_any(low, L.TABULAR) | F.rlike(q, F.lit(L.TABLE_REFERENCE)),
        "relationship": X.has_any(low, L.RELATIONSHIP),
        "comparison": X.has_any(low, L.COMPARISON),
        "multi_hop_markers": X.count_of(low, L.MULTI_HOP),
        "summary": X.has_any(low, L.SUMMARY),
        "procedural": X.has_any(low, L.PROCEDURAL),
        "definition": X.has_any(low, L.DEFINITION),
        "analytic": X.has_any(low, L.ANALYSIS),
        "cross_document": X.has_any(low, L.CROSS_DOCUMENT),
        "numeric": F.rlike(q, F.lit(L.NUMERIC)),
        "value_seeking": X.has_any(low, L.VALUE),
        "question_marks": _count(q, r"\?"),
        "conjunctions": _count(low, L.CONJUNCTION),
        "interrogatives": _count(q, L.INTERROGATIVE),
        "chained": _count(q, L.CHAINED),
        "follow_up": F.rlike(low, F.lit(L.FOLLOW_UP)),
        "verifiable": X.has_any(low, L.VERIFICATION),
    })
    c = F.col
    d = d.withColumn("multi_hop", (c("chained") >= 1) | (c("interrogatives") >= 3) | (c("multi_hop_markers") >= 2) | (c("question_marks") > 1) | (c("comparison") & (c("conjunctions") >= 1) & (c("word_count") > 10)) | (c("relationship") & c("cross_document")) | ((c("conjunctions") >= 2) & (c("word_count") > 14)))
    intent = (
        F.when(c("requires_visual"), "visual")
        .when(c("multi_hop") & ((c("chained") >= 1) | (c("interrogatives") >= 3)), "multi_hop")
        .when(c("summary"), "summarization").when(c("comparison"), "comparison").when(c("relationship"), "relationship").when(c("procedural"), "procedural")
        .when(c("definition") & ~(c("value_seeking") | (F.size("terms") > 0)), "definition").when(c("analytic"), "analysis")
        .when((c("question_marks") > 1) | (c("multi_hop_markers") >= 2), "multi_hop").otherwise("factual_lookup")
    )
    flag = lambda x: x.cast("int")
    score = 2 * flag(c("multi_hop")) + flag(c("interrogatives") >= 3) + flag(c("comparison")) + flag(c("relationship")) + flag(c("cross_document")) + flag(c("word_count") > 18) + flag(c("analytic")) + flag(c("summary") & (c("word_count") > 10)) - flag((c("word_count") <= 6) & ~c("multi_hop"))
    density = F.when(c("n_tokens") == 0, 0.0).otherwise(F.size("terms") / F.greatest(F.lit(1), c("n_tokens")))
    d = d.withColumns({"intent": intent, "complexity_score": score, "density": density})
    weight = lambda x, w: F.when(x, w).otherwise(0.0)
    d = d.withColumns({
        "complexity": F.when(c("complexity_score") >= 4, "complex").when(c("complexity_score") >= 2, "moderate").otherwise("simple"),
        "keyword_requirement": F.round(F.least(F.lit(1.0), 0.25 + c("density") * 1.5 + weight(F.size("quoted") > 0, 0.25) + weight(c("numeric"), 0.15)), 3),
        "semantic_requirement": F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.35 + weight(c("analytic"), 0.2) + weight(c("summary"), 0.15) + weight(c("definition"), 0.15) + weight(c("word_count") > 14, 0.1) - c("density") * 0.5)), 3),
        "expected_documents": F.when(c("cross_document") | c("comparison"), 3).when(c("multi_hop"), 2).otherwise(1),
        "ambiguity": F.round(F.least(F.lit(1.0), weight(c("word_count") <= 3, 0.4) + weight((F.size("terms") == 0) & (F.size("quoted") == 0), 0.2) + weight(c("follow_up"), 0.35)), 3),
        "key_terms": F.slice(F.concat("quoted", "terms"), 1, 10),
        "entities": F.slice("terms", 1, 10),
    })
    return d.withColumns({"relationship_query": c("relationship") | c("comparison"), "requires_verification": c("verifiable") | c("numeric") | (c("complexity") == "complex")})


def modalities(visual: Column, tabular: Column) -> Column:
    """Modalities that a query needs besides text."""
    return F.filter(F.array(F.when(visual, "figure"), F.when(visual, "image"), F.when(visual, "ocr"), F.when(tabular, "table")), lambda m: m.isNotNull())


# What a model may name, and what a merged analysis keeps of it.
INTENTS = ["factual_lookup", "definition", "comparison", "relationship", "multi_hop", "summarization", "analysis", "visual", "procedural", "exploratory"]
OR_FIELDS = ["multi_hop", "requires_visual", "requires_tabular", "relationship_query", "cross_document", "requires_verification"]
MAX_FIELDS = ["semantic_requirement", "keyword_requirement", "expected_documents", "ambiguity"]


def merge_judgement(analyzed: DataFrame, judged: DataFrame, key: str = "query_id") -> DataFrame:
    """``analyzed`` merged with a model's table (key and any of the fields of an analysis; each may be null).

    Booleans by OR, numbers by maximum, the higher complexity, a known intent instead of the own; entities and key terms joined, up to 12, the own
    first; the model's ``sub_questions``, up to six that say something, and its ``reasoning`` are added where the table has them."""
    both, has = analyzed.alias("a").join(judged.alias("j"), key, "left"), set(judged.columns)
    rank = lambda c: F.when(c == "complex", 2).when(c == "moderate", 1).when(c == "simple", 0)
    own, said = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"j.{c}"))
    new = {c: own(c) | F.coalesce(said(c), F.lit(False)) for c in OR_FIELDS if c in has}
    new |= {c: F.greatest(own(c), said(c)) for c in MAX_FIELDS if c in has}  # nulls don't count
    if "complexity" in has:
        low = F.lower(said("complexity"))
        new["complexity"] = F.when(F.coalesce(rank(low), F.lit(-1)) > rank(own("complexity")), low).otherwise(own("complexity"))
    if "intent" in has:
        new["intent"] = F.when(F.lower(said("intent")).isin(INTENTS), F.lower(said("intent"))).otherwise(own("intent"))
    for c in ("entities", "key_terms"):
        if c in has:
            new[c] = X.merge_strings(own(c), F.coalesce(said(c), F.array().cast("array<string>")), 12)
    more = []
    if "sub_questions" in has:
        bare = F.transform(F.coalesce(said("sub_questions"), F.array().cast("array<string>")), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
        more.append(F.slice(F.filter(bare, lambda s: F.coalesce(s, F.lit("")) != ""), 1, 6).alias("sub_questions"))
    if "reasoning" in has:
        more.append(F.nullif(F.trim(said("reasoning")), F.lit("")).alias("reasoning"))
    kept = [c for c in analyzed.columns if not (c in ("sub_questions", "reasoning") and c in has)]
    return both.select(*(new[c].alias(c) if c in new else F.col(f"a.{c}" if c != key else key).alias(c) for c in kept), *more)


def route(analyzed: DataFrame, document_count: int = 10, graph_available: bool = True, multimodal_available: bool = True, top_k: int = 8, pool: int = 40, sub_questions: int = 0) -> DataFrame:
    """The strategy decision: the first of six exclusive rules, corrective and agentic escalation, and a cost estimate."""
    c = F.col
    first = (
        F.when((c("requires_visual") | c("requires_tabular")) & multimodal_available, "visual_or_tabular_requirement")
        .when((c("relationship_query") | c("multi_hop") | (c("intent") == "relationship")) & graph_available, "relationship_or_multi_hop")
        .when((c("keyword_requirement") >= 0.55) & (c("keyword_requirement") > c("semantic_requirement")), "keyword_dominant")
        .when((c("semantic_requirement") >= 0.6) & (c("complexity") != "simple") & c("intent").isin("analysis", "exploratory", "definition", "summarization", "procedural"), "high_semantic_difficulty")
        .when((c("intent") == "comparison") | (c("cross_document") & (c("expected_documents") > 1)), "cross_document_comparison")
        .otherwise("simple_lookup_default")
    )
    d = analyzed.withColumn("rule", first)
    is_ = lambda r: c("rule") == r
    simple = is_("simple_lookup_default") & (c("complexity") == "simple")
    with_keywords = (is_("visual_or_tabular_requirement") & (c("keyword_requirement") >= 0.5)) | (is_("relationship_or_multi_hop") & (c("keyword_requirement") >= 0.45)) | (is_("high_semantic_difficulty") & (c("keyword_requirement") >= 0.5))
    corrective = c("requires_verification") | (c("complexity") == "complex") | (c("ambiguity") >= 0.4)
    signals = (c("complexity") == "complex").cast("int") + c("multi_hop").cast("int") + int(sub_questions >= 2) + (c("expected_documents") >= 3).cast("int") + c("intent").isin("multi_hop", "analysis").cast("int")
    total = c("keyword_requirement") + c("semantic_requirement")
    sparse = F.round(F.least(F.lit(0.75), c("keyword_requirement") / F.when(total == 0, 1.0).otherwise(total)), 3)
    d = d.withColumns({
        "strategy": F.when(is_("visual_or_tabular_requirement"), "multimodal").when(is_("relationship_or_multi_hop"), "graph").when(is_("keyword_dominant") | is_("cross_document_comparison"), "hybrid").when(is_("high_semantic_difficulty"), "hyde").otherwise("naive"),
        "parallel": F.when(with_keywords, "hybrid"),
        "use_corrective": corrective,
        "agentic_signals": signals,
        "use_agentic": (signals >= 3) & (document_count >= 1),
        "sparse_weight": F.when(is_("keyword_dominant"), sparse),
    })
    wide = is_("cross_document_comparison")
    k = F.when(wide, max(top_k, 10)).when(simple, min(top_k, 6)).otherwise(top_k)
    depth = F.when(is_("relationship_or_multi_hop") & c("multi_hop"), 3).otherwise(2)
    small = (F.lit(document_count) <= 1) & (c("strategy") == "graph")
    rerank = c("use_corrective") | ~simple
    d = d.withColumns({
        "top_k": F.when(c("use_agentic"), F.greatest(k, F.lit(10))).otherwise(k),
        "candidate_pool": F.when(wide, int(pool * 1.5)).when(simple, min(pool, 24)).otherwise(pool),
        "graph_depth": F.when(small, F.least(depth, F.lit(2))).otherwise(depth),
        "max_per_document": F.when(wide, F.greatest(F.lit(2), F.floor(F.lit(max(top_k, 10)) / F.greatest(F.lit(2), c("expected_documents")))).cast("int")),
        "rerank": rerank,
        "mode": F.when(c("use_agentic"), "agentic").when(c("parallel").isNotNull(), "composed").otherwise("single"),
        "llm_calls": 4 + (c("strategy") == "hyde").cast("int") + 2 * c("use_corrective").cast("int") + 4 * c("use_agentic").cast("int") + rerank.cast("int"),
    })
    fired = F.array(
        c("rule"),
        F.when(with_keywords, F.when(is_("visual_or_tabular_requirement"), "visual_with_exact_terms").when(is_("relationship_or_multi_hop"), "graph_with_exact_terms").otherwise("hyde_with_exact_terms")),
        F.when(simple, "cost_guard_simple_query"),
        F.when(corrective, "corrective_wrapping"),
        F.when(c("use_agentic"), "agentic_escalation"),
        F.when(small, "small_kb_graph_depth_cap"),
    )
    drivers = F.array(
        F.when(c("multi_hop"), "multi-hop reasoning"), F.when(c("relationship_query"), "relationship traversal"), F.when(c("keyword_requirement") >= 0.55, "exact terminology matching"), F.when(c("semantic_requirement") >= 0.6, "conceptual/semantic matching"),
        F.when(c("requires_visual"), "figure and chart evidence"), F.when(c("requires_tabular"), "tabular evidence"), F.when(c("cross_document"), "cross-document synthesis"), F.when(corrective, "evidence verification"),
    )
    named = F.filter(drivers, lambda x: x.isNotNull())
    because = F.when(F.size(named) == 0, "a direct single-fact lookup").otherwise(F.array_join(named, ", "))
    return d.withColumns({"rules_fired": F.filter(fired, lambda x: x.isNotNull()), "reason": F.concat(F.lit("Selected "), F.concat_ws(" + ", "strategy", "parallel"), F.lit(" because the query requires "), because, F.lit("."))})


#: Fields of a routing decision that a request may override.
OVERRIDABLE = ["top_k", "candidate_pool", "rerank", "sparse_weight", "graph_depth"]


def apply_overrides(routed: DataFrame, overrides: dict) -> DataFrame:
    """Values for ``OVERRIDABLE`` fields, which leave ``request_overrides`` among the rules fired; other names and nulls are ignored."""
    own = {k: F.lit(v) for k, v in overrides.items() if k in OVERRIDABLE and v is not None}
    return routed.withColumns(own | {"rules_fired": F.array_append("rules_fired", F.lit("request_overrides"))}) if own else routed


#: Names of the strategies.
STRATEGIES = ["naive", "hybrid", "hyde", "multimodal", "corrective", "graph", "adaptive", "agentic"]


def forced(names: list[str]) -> dict:
    """The decision for pinned strategies: unknown names are skipped, none means naive, wrappers aren't primary."""
    valid = [n for x in names if (n := x.lower()) in STRATEGIES] or ["naive"]
    core = [n for n in valid if n not in ("corrective", "agentic", "adaptive")]
    parallel = core[1:]
    return {
        "strategy": core[0] if core else "naive",
        "parallel": parallel,
        "use_corrective": "corrective" in valid,
        "use_agentic": "agentic" in valid,
        "mode": "agentic" if "agentic" in valid else "composed" if parallel else "single",
        "rules_fired": ["explicit_strategy_override"],
    }


def apply_forced(routed: DataFrame, names: list[str]) -> DataFrame:
    """``routed`` with the decision of ``forced`` in place of the router's; ``parallels`` has all strategies beside the first, ``parallel`` the first of them."""
    d = forced(names)
    beside = F.lit(d["parallel"][0]) if d["parallel"] else F.lit(None).cast("string")
    return routed.withColumns({"strategy": F.lit(d["strategy"]), "parallel": beside, "parallels": X.lits(d["parallel"]).cast("array<string>"), "use_corrective": F.lit(d["use_corrective"]), "use_agentic": F.lit(d["use_agentic"]), "mode": F.lit(d["mode"]), "rules_fired": F.array(*map(F.lit, d["rules_fired"]))})


def condense_history(turns: DataFrame, latest: DataFrame, conversation: str = "conv_id", turn: str = "turn", window: int = 6) -> DataFrame:
    """``latest`` (conversation, turn, query) with ``condensed``: a short follow-up gets up to five technical terms of the
    user turns among the last ``window`` turns before it, newest first."""
    from pyspark.sql import Window

    before = turns.withColumn("back", F.row_number().over(Window.partitionBy(conversation).orderBy(F.col(turn).desc())))
    recent = before.filter((F.col("back") <= window) & (F.col("role") == "user"))
    per = recent.select(conversation, F.struct("back", X.technical_terms("text").alias("terms")).alias("t"))
    known = per.groupBy(conversation).agg(F.sort_array(F.collect_list("t")).alias("ts"))  # at most `window` turns
    terms = F.array_distinct(F.flatten(F.transform("ts", lambda t: t["terms"])))
    joined = latest.join(known.select(conversation, terms.alias("recent")), conversation, "left")
    new = F.slice(F.filter(F.coalesce("recent", F.array().cast("array<string>")), lambda t: ~F.contains(F.lower("query"), F.lower(t))), 1, 5)
    follows = (F.size(X.tokenize("query")) <= 6) & (F.size(new) > 0)
    return joined.withColumn("condensed", F.when(follows, F.concat_ws(" ", "query", F.array_join(new, " "))).otherwise(F.col("query"))).drop("recent")


# Words that the generalised rewrite leaves out.
QUALIFIERS = ["what", "which", "how", "why", "when", "where", "who", "does", "did", "is", "are", "explain", "describe", "compare", "exactly", "specifically", "please"]


def heuristic_rewrites(queries: DataFrame, query: str = "query", most: int = 3) -> DataFrame:
    """(query_id, n, rewrite): terms and content words; without interrogatives and qualifiers; the four longest words."""
    q, words, terms = F.col(query), X.tokenize(query), X.technical_terms(query)
    dense = F.when(F.size(terms) > 0, F.array_join(F.array_distinct(F.concat(terms, F.slice(words, 1, 6))), " ")).otherwise(F.array_join(F.slice(words, 1, 8), " "))
    general = F.array_join(F.filter(F.regexp_extract_all(q, F.lit(r"\S+"), F.lit(0)), lambda w: ~F.regexp_replace(F.lower(w), r"^[?,.]+|[?,.]+$", "").isin(QUALIFIERS)), " ")
    general = F.when(general != q, F.regexp_replace(general, r"^[ ?]+|[ ?]+$", "")).otherwise("")
    longest = F.transform(F.slice(F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))), 1, 4), lambda s: s["w"])
    core = F.when(F.size(words) > 3, F.array_join(longest, " ")).otherwise("")
    bare = F.regexp_replace(F.lower(q), r"^[ ?]+|[ ?]+$", "")
    kept = X.distinct_ignoring_case(F.filter(F.array(dense, general, core), lambda x: (x != "") & (F.lower(x) != bare)))
    return queries.select("query_id", F.posexplode(F.slice(kept, 1, most)).alias("n", "rewrite"))


def expand_with_entities(query: Column, names: Column, limit: int = 4) -> Column:
    """The query followed by up to ``limit`` entity names that it lacks."""
    new = F.slice(F.filter(names, lambda n: (n != "") & ~F.contains(F.lower(query), F.lower(n)) & ~F.lower(n).isin(L.STOPWORDS)), 1, limit)
    return F.when(F.size(new) > 0, F.concat_ws(" ", query, F.array_join(new, " "))).otherwise(query)
