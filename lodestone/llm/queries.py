"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import between, stored, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.sharding import shard

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shard(docs, 40, keep_text=False, text_crc32=F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from lodestone.llm.pretokens import read_ranks
    from lodestone.llm.token_counts import count_tokens, zipf_scores

    scores = zipf_scores(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, scores, public_tokenizers.PATTERN, public_tokenizers.PATTERN).drop("text")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontaminate import report

    found = report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from lodestone.llm.bpe import round_trip
    from lodestone.llm.pretokens import read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = round_trip(docs, ranks, public_tokenizers.PATTERN, public_tokenizers.PATTERN, keep_text=False)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import judge

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "word_log_perplexity")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.katz import score

    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.pii import find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.line_dedup import drop_boilerplate

    return drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=("n_lines", "n_dropped"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.minhash_join import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.merkle import folded, manifest, proof_digest, row_digest

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = row_digest(*(F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in fields))
    tampered = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull(), tampered)
    proved = manifest(table(spark, sf_dir, "documents").select(*fields), fields, keep={"tampered": tampered})
    proved = proved.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _periodic_text(doc_id: str, text: str) -> Column:
    """The text whose words, for every tenth document by checksum, repeat a stretch from some place on."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        cycle = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), cycle), F.lit(1), n.cast("int")), " ")).otherwise("")

    words = F.array(between(F.col(text), r"[\x20\x09-\x0D]+"))  # one element, so that its words are made once
    return F.when(h % 10 == 0, F.get(F.transform(words, repeated), F.lit(0))).otherwise(F.col(text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.periodic import find_runs, strongest

    docs = table(spark, sf_dir, "documents").select("doc_id", _periodic_text("doc_id", "text").alias("text"))
    found = find_runs(docs).withColumn("best", strongest(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from lodestone.llm.chat import bpe_counter, read_back, windows
    from lodestone.llm.pretokens import read_ranks

    count = bpe_counter(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, public_tokenizers.PATTERN)
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(stored(windows(said.unionByName(tricky), count), "chat_windows"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_token_counts, op3_benchmark_decontamination, op4_license_scan, op5_byte_bpe, op6_quality_rules, op7_lm_scoring, op8_personal_data, op9_line_dedup, op10_minhash_near_dedup, op11_merkle_manifest, op12_periodic_runs, op13_chat_windows)}
