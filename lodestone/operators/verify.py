"""Verification: claims, evidence matching, citations, confidence and abstention, for all answers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import lexicons as L
from lodestone.functions import text as X


def _any(low: Column, bank: list[str]) -> Column:
    return X.has_any(low, bank)


def _starts(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def sentences(answers: DataFrame, answer_id: str = "answer_id", text: str = "answer") -> DataFrame:
    return answers.select(F.col(answer_id).alias("answer_id"), F.posexplode(X.split_sentences(text)).alias("pos", "sentence"))


def claims(answers: DataFrame, answer_id: str = "answer_id", text: str = "answer", most: int = 15) -> DataFrame:
    """(answer_id, claim_index, claim, cited, claim_type): the checkable sentences of each answer; of several types the last named wins."""
    s, low = F.col("sentence"), F.lower("sentence")
    ok = (F.length(s) >= 25) & ~F.contains(low, F.lit(L.ABSTENTION)) & ~_starts(low, L.META_PREFIXES) & ~_starts(s, ["|", "#", "```"]) & (F.size(X.tokenize("sentence")) >= 4)
    kind = F.when(_any(low, L.HEDGES), "hedged").when(_any(low, L.DEFINING), "definition").when(_any(low, L.CAUSAL), "causal").when(_any(low, L.COMPARATIVE), "comparative").when(F.rlike(s, F.lit(r"\d")), "numeric").otherwise("factual")
    nth = F.row_number().over(Window.partitionBy("answer_id").orderBy("pos")) - 1
    return sentences(answers, answer_id, text).filter(ok).withColumn("claim_index", nth).filter(F.col("claim_index") < most).select("answer_id", "claim_index", X.strip_markers("sentence").alias("claim"), X.markers("sentence").alias("cited"), kind.alias("claim_type"))


def lexical_match(claims_: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim with its best lexical score, up to three supporting chunks and whether the evidence has its numbers.

    ``evidence``: (answer_id, chunk_id, rank, content). Tokens of a chunk are taken once; claims meet the
    evidence of their own answer only."""
    ev = evidence.select("answer_id", "chunk_id", "rank", X.tokenize("content").alias("et"), X.numbers("content").alias("en")).withColumn("ef", X.term_counts(F.col("et")))
    cl = claims_.select("answer_id", "claim_index", "claim", "claim_type", "cited", X.tokenize("claim").alias("ct"), X.numbers("claim").alias("cn")).withColumn("cf", X.term_counts(F.col("ct")))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, n: s + (n * n).cast("double")))
    num = F.aggregate(F.map_entries("cf"), F.lit(0.0), lambda s, e: s + (e["value"] * F.coalesce(F.element_at("ef", e["key"]), F.lit(0))).cast("double"))
    cosine = F.when((F.size("ct") == 0) | (F.size("et") == 0), 0.0).otherwise(num / (norm("cf") * norm("ef")))
    pair = cl.join(ev, "answer_id", "left").withColumn("s", F.round(0.6 * X.coverage(F.col("ct"), F.col("et")) + 0.4 * cosine, 9))
    own = pair.groupBy("answer_id", "claim_index").agg(
        F.first("claim").alias("claim"), F.first("claim_type").alias("claim_type"), F.first("cited").alias("cited"), F.first("cn").alias("cn"),
        F.max("s").alias("best"),
        F.sort_array(F.collect_list(F.when(F.col("chunk_id").isNotNull(), F.struct((-F.col("s")).alias("o"), F.col("rank"), F.col("chunk_id"))))).alias("scored"),
        F.array_distinct(F.flatten(F.collect_list("en"))).alias("numbers"),
    )
    enough = F.greatest(F.lit(0.3), F.col("best") * 0.75)
    support = F.slice(F.transform(F.filter("scored", lambda x: -x["o"] >= enough), lambda x: x["chunk_id"]), 1, 3)
    consistent = (F.size("scored") > 0) & (F.size(F.array_except("cn", "numbers")) == 0)
    return own.select("answer_id", "claim_index", "claim", "claim_type", "cited", F.round(F.coalesce("best", F.lit(0.0)), 4).alias("lexical_score"), support.alias("evidence_ids"), consistent.alias("numeric_ok"))


def verdicts(matched: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Verdict and support of each claim; a judge table (answer_id, claim_index, j_verdict, j_support) blends .7/.3; numbers without evidence cap the support."""
    d = matched
    lexical = F.when((F.col("lexical_score") >= 0.55) & F.col("numeric_ok"), "supported").when(F.col("lexical_score") >= 0.3, "partially_supported").otherwise("unsupported")
    support, verdict = F.col("lexical_score"), lexical
    if judged is not None:
        d = d.join(judged, ["answer_id", "claim_index"], "left")
        support = F.when(F.col("j_verdict").isNotNull(), F.round(0.7 * F.col("j_support") + 0.3 * F.col("lexical_score"), 4)).otherwise(support)
        verdict = F.coalesce("j_verdict", lexical)
    d = d.withColumns({"verdict": verdict, "support_score": support})
    return d.withColumns({
        "support_score": F.when(F.col("numeric_ok"), F.col("support_score")).otherwise(F.round(F.least("support_score", F.lit(0.35)), 4)),
        "verdict": F.when(~F.col("numeric_ok") & (F.col("verdict") == "supported"), "partially_supported").otherwise(F.col("verdict")),
    }).drop("j_verdict", "j_support")


def citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, valid, invalid, factual, cited_sentences, coverage, accuracy): markers against the number of evidence rows."""
    n = evidence.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"))
    s = F.col("sentence")
    # fixed values: what opens a line that asserts nothing, and the least a sentence needs
    need = ~_starts(s, ["|", "#", "```", "-", "*"]) & F.rlike(s, F.lit("[A-Za-z]{3,}")) & (F.length(s) >= 25)
    own = sentences(answers).filter(need).join(n, "answer_id", "left").withColumn("m", X.markers("sentence"))
    ok = lambda m: (m >= 1) & (m <= F.coalesce("n", F.lit(0)))
    own = own.withColumns({"v": F.filter("m", ok), "i": F.filter("m", lambda m: ~ok(m))})
    per = own.groupBy("answer_id").agg(F.count(F.lit(1)).alias("factual"), F.count_if(F.size("v") > 0).alias("cited_sentences"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("v")))).alias("valid"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("i")))).alias("invalid"))
    none = F.array().cast("array<int>")
    d = answers.select("answer_id", X.is_abstention("answer").alias("abstention")).join(per, "answer_id", "left")
    skip = F.col("abstention")
    d = d.select("answer_id", "abstention", *(F.when(skip, none).otherwise(F.coalesce(c, none)).alias(c) for c in ("valid", "invalid")), *(F.when(skip, 0).otherwise(F.coalesce(c, F.lit(0))).alias(c) for c in ("factual", "cited_sentences")))
    marks = F.size("valid") + F.size("invalid")
    return d.withColumns({
        "coverage": F.when(skip, 1.0).when(F.col("factual") == 0, 0.0).otherwise(F.round(F.col("cited_sentences") / F.nullif(F.col("factual"), F.lit(0)), 4)),
        "accuracy": F.when(marks == 0, 0.0).otherwise(F.round(F.size("valid") / F.nullif(marks, F.lit(0)), 4)),
    })


def citation_records(evidence: DataFrame, words: int = 60) -> DataFrame:
    """One record for each evidence row: its number, document, page, section, place and excerpt; null where the evidence lacks a field."""
    of = lambda c, kind: F.col(c) if c in evidence.columns else F.lit(None).cast(kind)
    page, section, figure, table = of("page_number", "int"), of("section", "string"), of("figure_label", "string"), of("table_label", "string")
    return evidence.select("answer_id", F.col("rank").alias("marker"), "chunk_id", of("document_id", "string").alias("document_id"), page.alias("page_number"), section.alias("section"), X.location(page, section, figure, table).alias("place"), F.col("score").alias("relevance"), X.truncate_words("content", words).alias("excerpt"))


def confidence(judged: DataFrame, cited: DataFrame, evidence: DataFrame, rounds: Column | None = None) -> DataFrame:
    """(answer_id, components, penalties, score, label). ``evidence`` needs answer_id, document_id, rank, score and n_sources."""
    v = judged.groupBy("answer_id").agg(
        F.avg("support_score").alias("claim_support"), F.count(F.lit(1)).alias("claims"), F.count_if(F.col("verdict") == "contradicted").alias("contradicted"),
        F.count_if(F.col("verdict") == "unsupported").alias("unsupported"), F.count_if(F.col("verdict").isin("supported", "partially_supported")).alias("supported"), F.count_if(~F.col("numeric_ok")).alias("numeric_failures"),
    )
    e = evidence.groupBy("answer_id").agg(
        F.max("score").alias("top"), F.avg(F.when(F.col("rank") <= 5, F.col("score"))).alias("mean5"),
        F.count_distinct(F.when(F.col("rank") <= 8, F.col("document_id"))).alias("documents"), F.avg(F.when(F.col("rank") <= 5, F.col("n_sources"))).alias("sources"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = cited.join(v, "answer_id", "left").join(e, "answer_id", "left").na.fill(0, ["claims", "contradicted", "unsupported", "supported", "numeric_failures", "documents"])
    d = d.withColumns({
        "claim_support": zero(F.col("claim_support")),
        "retrieval_quality": zero(0.6 * F.col("top") + 0.4 * F.col("mean5")),
        "evidence_agreement": F.when(F.col("documents") > 1, F.least(F.lit(1.0), (F.col("documents") - 1) / 2)).otherwise(0.35),
        "strategy_consensus": zero(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("sources") - 1) / 2))),
        "citation_coverage": F.col("coverage"),
        "citation_accuracy": F.col("accuracy"),
    })
    base = sum((F.col(k) * w for k, w in L.CONFIDENCE.items()), F.lit(0.0))
    share = F.when(F.col("claims") == 0, 0.0).otherwise(F.col("unsupported") / F.nullif(F.col("claims"), F.lit(0)))
    penalty = (
        F.least(F.lit(0.35), 0.18 * F.col("contradicted"))
        + F.when(share > 0.3, F.least(F.lit(0.2), share * 0.25)).otherwise(0.0)
        + F.least(F.lit(0.12), 0.04 * F.size("invalid"))
        + F.least(F.lit(0.18), 0.06 * F.col("numeric_failures"))
        + (F.when(rounds, 0.12).otherwise(0.0) if rounds is not None else F.lit(0.0))
    )
    d = d.withColumns({"penalty": penalty, "score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - penalty)), 4)})
    return d.withColumn("label", F.when(F.col("score") >= 0.72, "high").when(F.col("score") >= 0.45, "medium").otherwise("low"))


#: What an answer is replaced by that its evidence doesn't support.
WITHHELD = L.ABSTENTION[0].upper() + L.ABSTENTION[1:] + "."


def verify(answers: DataFrame, evidence: DataFrame, threshold: float = 0.35, least_support: float = 0.5, judged: DataFrame | None = None, rounds: Column | None = None) -> DataFrame:
    """The whole check: (answer_id, answer, modified, score, label, claims, supported, abstained, reason).

    Markers without evidence are taken out of an answer. It abstains without evidence, where the answer says so itself, and where confidence is low and
    support or retrieval is weak; then the answer is replaced, without repeating what it claimed. Answers with an ``error`` are passed
    through unchecked: score and label are null."""
    failed = F.col("error").isNotNull() if "error" in answers.columns else F.lit(False)
    d = confidence(verdicts(lexical_match(claims(answers), evidence), judged), citations(answers, evidence), evidence, rounds)
    d = answers.select("answer_id", "answer", failed.alias("failed")).join(d, "answer_id")
    ratio = F.when(F.col("claims") == 0, 0.0).otherwise(F.col("supported") / F.nullif(F.col("claims"), F.lit(0)))
    poor = F.col("retrieval_quality") < threshold
    weak = (F.col("score") < threshold) & ((ratio < least_support) | poor)
    none, own = F.col("top").isNull(), F.col("abstention")
    details = F.filter(F.array(
        F.when(F.col("claims") > F.col("supported"), F.concat((F.col("claims") - F.col("supported")).cast("string"), F.lit(" of "), F.col("claims").cast("string"), F.lit(" statements have no matching passage"))),
        F.when(F.col("numeric_failures") > 0, F.lit("figures of the draft are not in the evidence")),
        F.when(poor, F.lit("the passages found are barely relevant")),
    ), lambda x: x.isNotNull())
    reason = F.when(F.col("failed"), "error").when(none, "no evidence").when(own, "declined").when(weak, F.array_join(details, "; "))
    abstained = ~F.col("failed") & (none | own | weak)
    text = (
        F.when(F.col("failed") | (own & ~none), F.col("answer")).when(none, F.lit(f"{WITHHELD}\n\nNo passage of the indexed documents matches this question."))
        .when(weak, F.concat(F.lit(f"{WITHHELD}\n\nThe passages found do not support a reliable answer"), F.when(F.size(details) > 0, F.concat(F.lit(": "), F.array_join(details, "; "))).otherwise(""), F.lit(".")))
        .otherwise(X.strip_invalid_markers("answer", F.array_union("valid", F.array().cast("array<int>"))))
    )
    d = d.withColumns({"text": text, "abstained": abstained, "reason": reason})
    return d.select(
        "answer_id", F.col("text").alias("answer"), (F.trim("text") != F.trim("answer")).alias("modified"), F.when(~F.col("failed"), F.when(abstained, 0.0).otherwise(F.col("score"))).alias("score"),
        F.when(~F.col("failed"), F.when(abstained, "abstained").otherwise(F.col("label"))).alias("label"), "claims", "supported", "abstained", "reason",
    )


def pack_evidence(ranked: DataFrame, budget: int = 7000) -> DataFrame:
    """Evidence in rank order up to the first overflow of ``budget`` tokens; the first always stays."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    own = ranked.withColumn("running", F.sum("token_count").over(w))
    return own.filter((F.col("running") <= budget) | (F.col("rank") == 1))


def format_history(turns: DataFrame, most: int = 6) -> DataFrame:
    """The last turns of each conversation as lines of role and text."""
    own = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))).filter(F.col("back") <= most)
    lines = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", F.initcap("role"), "text").alias("line"))))
    return own.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


def grade(queries: DataFrame, ranked: DataFrame, floor: float = 0.45) -> DataFrame:
    """(query_id, overall, diagnosis): retrieval quality from scores and lexical overlap of the first results."""
    own = ranked.join(queries.select("query_id", "query"), "query_id").filter(F.col("rank") <= 6).withColumn("cov", X.coverage(X.tokenize("query"), X.tokenize("content")))
    five = F.col("rank") <= 5
    agg = own.groupBy("query_id").agg(F.max(F.when(five, F.col("score"))).alias("top"), F.avg(F.when(five, F.col("score"))).alias("mean5"), F.max(F.when(five, F.col("cov"))).alias("best"), F.avg(F.when(five, F.col("cov"))).alias("mean_cov"), F.array_join(F.collect_list(F.lower("content")), " ").alias("joined"))
    d = queries.select("query_id", X.technical_terms("query").alias("terms")).join(agg, "query_id", "left")
    rate = F.when(F.size("terms") == 0, 0.0).otherwise(F.size(F.filter("terms", lambda t: F.contains("joined", F.lower(t)))) / F.size("terms"))
    d = d.withColumn("rate", rate)
    quality = 0.45 * F.col("top") + 0.2 * F.col("mean5") + 0.2 * F.col("best") + 0.15 * F.when(F.col("rate") == 0, F.col("mean_cov")).otherwise(F.col("rate"))
    d = d.withColumn("q", quality)
    diagnosis = (
        F.when(F.col("top").isNull(), "empty")
        .when((F.size("terms") > 0) & (F.col("rate") == 0) & (F.col("best") < 0.25), "off_topic")
        .when(F.col("top") < floor * 0.6, "off_topic")
        .when((F.col("best") < 0.2) & (F.col("top") < floor), "too_general")
        .when(F.col("q") < floor, "partially_relevant")
        .otherwise("good")
    )
    return d.select("query_id", F.round(F.least(F.lit(1.0), F.coalesce("q", F.lit(0.0))), 4).alias("overall"), diagnosis.alias("diagnosis"))
