"""The operators applied to the driver's tables with production parameters, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chat_format, chosen_path, decontamination, line_dedup, lloyd, packing, periodic_runs, projection_forest, quality, threshold_search, token_counts, toxicity, warc
from quillspark.llm.common import fold_crc, table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = lambda: F.pmod(fold_crc(F.col("doc_id")), F.lit(3))
    model = quality.fit(docs, labels, fold() != 1)
    return quality.score(docs, model).select("doc_id", (fold() == 1).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "url_key", "ts", "status", "response_id", "digest", F.array_join(lines, "\n").alias("headers"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = lambda: F.pmod(fold_crc(F.col("doc_id")), F.lit(4))
    model = toxicity.fit(docs, labels, fold() != 2)
    return toxicity.score(docs, model).select("doc_id", (fold() == 2).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = chat_format.with_extra(table(spark, sf_dir, "conversations"), -7, [("user", said), ("assistant", said)])
    return chat_format.digests(chat_format.format_conversations(rows))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.lloyd(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text", periodic_runs.planted(F.col("doc_id"), F.col("text")))
    return periodic_runs.digests(periodic_runs.find_runs(docs))


def op13_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.top_scores(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_decontamination, op3_revisits, op4_ngram_join, op5_near_vectors, op6_toxicity, op7_line_dedup, op8_packing, op9_chat_format, op10_token_counts, op11_lloyd, op12_periodic_runs, op13_top_scores)
}
