"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and works on all of ``docs``.

All but the last return the columns of ``docs``, whatever their names: only doc_id and text (and n_chars where the text
changes) mean something to a stage, the others travel along. Each keeps null, empty and wordless texts and rows without
id; repeated rows are judged alike, and each by itself unless a stage says otherwise; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chosen_path, decontamination, line_dedup, packing, toxicity
from quillspark.llm.common import Sieve, fold_crc, table
from quillspark.llm.queries import tokenizer_path


def narrowed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and rest: a struct of all other columns, so that no operator's own columns clash with them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    filler = F.lit(0).alias("_" * (1 + max(map(len, docs.columns))))  # a struct needs one field at least
    return docs.select("doc_id", "text", F.struct(*others, filler).alias("rest"))


def widened(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not flag; it learns from the rows that are not held out."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, F.pmod(fold_crc(F.col("doc_id")), F.lit(4)) != 2)
    rows = narrowed(docs)
    return widened(toxicity.score(rows, model, keep=rows.columns).where("predicted = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller document holds; a null text stays null. n_chars follows the text, if there is one."""
    out = line_dedup.drop_lines(narrowed(docs))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n_chars = F.when(F.col("n_dropped") > 0, F.char_length(text).cast(kind)).otherwise(F.col("rest.n_chars"))
        out = out.withColumn("rest", F.col("rest").withField("n_chars", n_chars))
    return widened(out.withColumn("text", text), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document, the first by id and a hash of its text; and all that are in no group.

    Rows are judged by id and text: of different texts under one id only those go that are near copies of another row.
    Of rows that are equal in both one stays, any of them.
    """
    rows = chosen_path.near_duplicate_rows(docs).where("n_links > 0").groupBy("doc_id", "mark", "set_class").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("set_class").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    said = F.when(~is_first, "goes").when(F.col("n") > 1, "once")
    judged = rows.join(first, "set_class").select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), said.alias("_said")).where("_said is not null")
    # what surely is in no group stays where it is
    place = F.xxhash64(F.col("doc_id").cast("long"), chosen_path.text_mark())
    sieve = Sieve(judged, F.xxhash64("_doc", "_mark"), judged.count())
    packed = narrowed(docs)
    maybe = sieve.passed(packed, place)
    same = (maybe["doc_id"].cast("long") == judged["_doc"]) & (F.xxhash64(maybe["text"]) == judged["_mark"])
    met = maybe.join(judged, same, "left")
    alone, once = met.where("_said is null"), met.where("_said = 'once'").dropDuplicates(["_doc", "_mark"])
    kept = [part.select("doc_id", "text", "rest") for part in (sieve.refused(packed, place), alone, once)]
    return widened(kept[0].unionByName(kept[1]).unionByName(kept[2]), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences they stand in, with their ids."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))
