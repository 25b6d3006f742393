"""Model judgements in batches: items are packed to a few for each call, a hook is asked once for each pack, and its answers are validated by joins.

A hook is a function from a request (a dict of the request's columns) to an answer (a dict, or None). It runs in the tasks; a
request that raises or has no answer gives a null answer and an ``error``, and everything below defines what that means. Requests are a
table, so a failed task asks again only what it had; ``stored`` the answers where a call is dear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as X
from lodestone.operators import verify as V

Hook = Callable[[dict], dict | None]
# Passages of a call, words of a passage, passages that grading looks at, how near the floor a grade must be to be asked about.
PACK, WORDS, GRADED, BORDER = 12, 120, 10, 0.22
DIAGNOSES = ["empty", "off_topic", "too_general", "wrong_document", "partially_relevant", "good"]


def pack(items: DataFrame, by: list[str], order: list[str], columns: list[str], size: int = PACK) -> DataFrame:
    """(*by, pack, items): the items of each group in their order, ``size`` to a pack. A group is a query's pool, which its search bounds."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    own = items.withColumn("_n", n).withColumn("pack", F.floor((F.col("_n") - 1) / size).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("_n", *columns)))
    return own.groupBy(*by, "pack").agg(F.transform(listed, lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias("items"))


def _plain(x):
    """Rows, arrays and numbers of pandas as Python's."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if hasattr(x, "tolist") and not isinstance(x, str):
        return _plain(x.tolist())
    return [_plain(v) for v in x] if isinstance(x, list) else x


def ask(requests: DataFrame, hook: Hook, answer: str) -> DataFrame:
    """``requests`` with ``answer``, a struct of the fields that the DDL ``answer`` names, and ``error``; both null where the hook has no answer.

    Fields that an answer lacks are null; a field of the wrong type makes the answer null."""
    kind = T.StructType.fromDDL(answer) if not isinstance(answer, T.StructType) else answer
    schema = T.StructType([*requests.schema.fields, T.StructField("answer", kind), T.StructField("error", T.StringType())])

    def checked(value, of):
        if value is None:
            return None
        if isinstance(of, T.StructType):
            return {f.name: checked(value.get(f.name), f.dataType) for f in of.fields}
        if isinstance(of, T.ArrayType):
            return [checked(v, of.elementType) for v in value]
        if isinstance(of, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(of, (T.IntegerType, T.LongType)):
            return int(value)
        return bool(value) if isinstance(of, T.BooleanType) else str(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, errors = [], []
            for row in pdf.to_dict("records"):
                try:
                    answers.append(checked(hook({k: _plain(v) for k, v in row.items()}), kind))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  whatever a model's client raises must not end the job
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pdf.assign(answer=pd.Series(answers, dtype=object, index=pdf.index), error=pd.Series(errors, dtype=object, index=pdf.index))

    return requests.mapInPandas(run, schema)


def _clamped(c: Column) -> Column:
    """A score in 0 to 1; null for null and for what isn't a number."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def judge_pool(questions: DataFrame, results: DataFrame, hook: Hook, depth: int = 10) -> DataFrame:
    """(query_id, chunk_id, relevant): labels of the pool of several strategies' first ``depth`` results, each passage judged once.

    ``results``: (query_id, strategy, chunk_id, rank, content). The hook gets query and items (id, text) and gives ``relevant_ids``;
    ids that it wasn't asked about are ignored, and passages of a failed call have a null label."""
    pool = results.filter(F.col("rank") <= depth).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.first("content").alias("content"))
    pool = pool.select("query_id", "rank", F.col("chunk_id").cast("string").alias("id"), "chunk_id", X.truncate_words("content", WORDS).alias("text"))
    packs = pack(pool, ["query_id"], ["rank", "chunk_id"], ["id", "text", "chunk_id"]).join(questions.select("query_id", "query"), "query_id")
    asked = ask(packs, hook, "relevant_ids array<string>")
    return asked.select("query_id", F.col("answer.relevant_ids").alias("ids"), F.explode("items").alias("i")).select("query_id", "i.chunk_id", F.array_contains("ids", F.col("i.id")).alias("relevant"))


def judge_answers(answers: DataFrame, evidence: DataFrame, faithfulness: Hook, relevance: Hook, context: Hook, words: int = WORDS) -> DataFrame:
    """(answer_id, faithfulness, answer_relevance, context_relevance): scores in 0 to 1 by three hooks; null for an empty answer or without an answer of the hook.

    ``answers``: (answer_id, query, answer); ``evidence``: (answer_id, chunk_id, rank, content). Evidence is given in rank order."""
    passages = F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("id"), X.truncate_words("content", words).alias("text"))))
    own = answers.select("answer_id", "query", F.substring("answer", 1, 6000).alias("answer_text")).join(evidence.groupBy("answer_id").agg(passages.alias("passages")), "answer_id", "left")
    own = own.withColumn("passages", F.coalesce("passages", F.array().cast(own.schema["passages"].dataType)))
    said, seen = own.filter(F.length(F.coalesce("answer_text", F.lit(""))) > 0), own.filter(F.size("passages") > 0)
    out = answers.select("answer_id")
    for name, rows, hook in (("faithfulness", said, faithfulness), ("answer_relevance", said.drop("passages"), relevance), ("context_relevance", seen.drop("answer_text"), context)):
        scores = ask(rows, hook, "score double").select("answer_id", _clamped(F.col("answer.score")).alias("_s"))
        out = out.join(scores.select("answer_id", F.round("_s", 4).alias(name)), "answer_id", "left")
    return out


def grade_borderline(queries: DataFrame, ranked: DataFrame, hook: Hook, floor: float = 0.45) -> DataFrame:
    """``V.grade`` (query_id, overall, diagnosis) with ``method``; a query whose grade lies within ``BORDER`` of the floor is graded by the hook instead.

    The hook gets query and passages (id, text) of the first results and gives grades ({id, score}), overall and diagnosis. Without a usable
    grade the lexical result stays; a missing overall is the mean of the grades, and an unknown diagnosis follows from overall."""
    lexical = V.grade(queries, ranked, floor)
    near = lexical.filter((F.abs(F.col("overall") - floor) < BORDER) & (F.col("diagnosis") != "empty")).select("query_id")
    own = ranked.filter(F.col("rank") <= GRADED).join(near, "query_id", "left_semi").select("query_id", "rank", F.col("chunk_id").cast("string").alias("id"), X.truncate_words("content", WORDS).alias("text"))
    requests = pack(own, ["query_id"], ["rank", "id"], ["id", "text"], GRADED).withColumnRenamed("items", "passages").join(queries.select("query_id", "query"), "query_id").drop("pack")
    asked = ask(requests, hook, "grades array<struct<id string, score double>>, overall double, diagnosis string")
    usable = F.filter("answer.grades", lambda g: g["score"].isNotNull() & ~F.isnan(g["score"]) & (F.coalesce(g["id"], F.lit("")) != ""))
    asked = asked.select("query_id", F.transform(usable, lambda g: _clamped(g["score"])).alias("g"), F.col("answer.overall").alias("o"), F.lower(F.trim("answer.diagnosis")).alias("d")).filter(F.size("g") > 0)
    overall = F.coalesce(_clamped(F.col("o")), F.aggregate("g", F.lit(0.0), lambda s, x: s + x) / F.size("g"))
    asked = asked.select("query_id", F.round(overall, 4).alias("asked"), "d").withColumn("d", F.when(F.col("d").isin(DIAGNOSES), F.col("d")).when(F.col("asked") >= 0.6, "good").otherwise("partially_relevant"))
    both = lexical.join(asked, "query_id", "left")
    return both.select("query_id", F.coalesce("asked", "overall").alias("overall"), F.coalesce("d", "diagnosis").alias("diagnosis"), F.when(F.col("asked").isNotNull(), "lexical+judge").otherwise("lexical").alias("method"))


def claims(answers: DataFrame, hook: Hook, most: int = 15) -> DataFrame:
    """``V.claims`` with ``method``: the claims that the hook finds in an answer, or the answer's own sentences where it finds none.

    The hook gets text and gives claims ({text, cited, type}); texts under 15 characters and refusals are left out; abstaining answers have no claims."""
    open_ = answers.filter((F.coalesce("answer", F.lit("")) != "") & ~X.is_abstention("answer"))
    asked = ask(open_.select("answer_id", F.substring("answer", 1, 8000).alias("text")), hook, "claims array<struct<text string, cited array<int>, type string>>")
    found = asked.select("answer_id", F.posexplode(F.slice("answer.claims", 1, most)).alias("pos", "c")).select("answer_id", "pos", F.regexp_replace("c.text", r"^\s+|\s+$", "").alias("t"), "c.cited", "c.type")
    found = found.filter((F.length("t") >= 15) & ~X.is_abstention("t"))
    nth = F.row_number().over(Window.partitionBy("answer_id").orderBy("pos")) - 1
    cited = F.filter(F.coalesce("cited", F.array().cast("array<int>")), lambda x: x.isNotNull())
    named = found.select("answer_id", nth.alias("claim_index"), X.strip_markers("t").alias("claim"), cited.alias("cited"), F.substring(F.coalesce("type", F.lit("factual")), 1, 24).alias("claim_type"), F.lit("judge").alias("method"))
    left = open_.join(named.select("answer_id"), "answer_id", "left_anti")
    return named.unionByName(V.claims(left, most=most).withColumn("method", F.lit("lexical")).select(named.columns))
