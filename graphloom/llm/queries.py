"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import blockmax, decontam, jaccard, langid, lines, lm, pii, quality, rules, sentencepiece_fst, sortmeans, syncmers, tokens
from graphloom.llm.common import table


def edit_log(text: Column) -> Column:
    """Three edits of every text, as a cleaning step leaves them: a cut, an insertion and a replacement."""
    n = F.coalesce(F.char_length(text), F.lit(0))

    def edit(start: Column, length: int, new: str) -> Column:
        at = start.cast("int")
        return F.struct(at.alias("start"), (at + length).alias("end"), F.lit(new).alias("text"))

    return F.array(edit(n / 4, 12, ""), edit(n / 2, 0, " [edited] "), edit(3 * n / 4, 5, "\u00e9 "))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over `documents`: trees of all texts, then three edits of each (see edit_log)."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_edited(documents.withColumn("edits", edit_log(F.col("text"))))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: `documents` against the windows of `benchmark`."""
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over `documents`: the ledger under the policies base-1 and full-1."""
    found = rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = rules.apply_policy(found, "base-1").withColumnRenamed("kept", "base_kept").drop("policy")
    return rules.apply_policy(base, "full-1").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"),
        "kept",
        "failure_bits",
        "policy",
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over `documents`; targets are those that a label calls good and none toxic."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return lm.score(documents, good)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over `documents`; scores are those of the spans, in their order."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [
        F.size(pii.of_kinds(F.col("pii"), [k])).cast("bigint").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")
    ]
    return found.select(
        "doc_id",
        *n,
        F.sha2(pii.spans_text(pii.of_kinds(F.col("pii"), pii.BASE)), 256).alias("base_sha256"),
        pii.spans_text(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda x: x["score"].cast("decimal(3,2)").cast("string")), ",").alias("scores"),
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: fitted on `labels` outside the held-out fold, scores all of `documents`."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.train(documents, table(spark, sf_dir, "labels"))
    return quality.classify(documents, forest).select(
        "doc_id",
        F.coalesce(quality.fold(F.col("doc_id"), quality.FOLDS) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over `documents`: five words, similarity of 0.8 or more."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over `documents`; the ids themselves are left out, their digest stays."""
    return sentencepiece_fst.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ids=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: fitted outside the held-out fold, predicts the language of all of `documents`."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(documents)
    return langid.identify(documents.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(langid.fold(F.col("doc_id"), langid.FOLDS) == langid.HELD_OUT, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over `documents`: lines of five words and more."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_lines",
        "n_copies",
        "n_near",
        "emptied",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over `embeddings`: 40 centroids, five rounds and a last assignment."""
    return sortmeans.cluster(table(spark, sf_dir, "embeddings"))


def op12_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: the 10 best of all `documents` for each item of `benchmark`."""
    return blockmax.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over `documents`: anchors of every text, of its edited one, and how alike they are."""
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = [
    op1_token_counts,
    op2_decontamination,
    op3_quality_rules,
    op4_lm_scoring,
    op5_pii,
    op6_quality_classifier,
    op7_ngram_jaccard,
    op8_sentencepiece,
    op9_language_id,
    op10_line_dedup,
    op11_sort_means,
    op12_block_max,
    op13_closed_syncmers,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
