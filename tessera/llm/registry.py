"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, dialogue, hardneg, langid, licenses, mih, mixing, neardup, pages, quality, sharding, suffix, toxicity
from tessera.llm.common import table


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_low_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("row.doc_id", "size", "source_size", "target", "taken", F.array_min(F.transform("pieces", lambda x: x["slot"])).alias("first_slot"), F.size("pieces").alias("n_pieces"))


def op9_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    out = sharding.shard(rows, [F.col("doc_id"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, labels.filter(fold != 0))
    scored = toxicity.score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mih.search(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


def op2_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.Params(public_tokenizers.path("byte_bpe_50k.json")))


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    c = {k: F.col(f"counts.{k}") for k in quality.COUNTS[:5]}
    failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    return out.select("doc_id", *[v.alias(k) for k, v in c.items()], failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes are removed; passages of over 50 words that stand elsewhere, too, are counted beside them."""
    passages = suffix.Params(length=51, gram=32, words=True)
    out = suffix.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True, report=passages)
    return out.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256", "cut.n_passages", "cut.n_passage_bytes")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = langid.fit(docs.filter(fold != 0))
    told = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return told.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt = dialogue.damaged(table(spark, sf_dir, "conversations"))
    return dialogue.report(dialogue.digests(dialogue.repair(hurt, F.col("copies"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0)


def queries() -> dict:
    return {"op6_license_scan": op6_license_scan, "op7_site_style_tree": op7_site_style_tree, "op1_multi_index_hashing": op1_multi_index_hashing, "op4_weak_supervision": op4_weak_supervision, "op8_low_discrepancy": op8_low_discrepancy, "op9_hypergeometric": op9_hypergeometric, "op3_chunked_bpe": op3_chunked_bpe, "op5_suffix_array": op5_suffix_array, "op2_prob_minhash": op2_prob_minhash, "op10_toxicity": op10_toxicity, "op11_language_id": op11_language_id, "op12_conversation_repair": op12_conversation_repair, "op13_hard_negatives": op13_hard_negatives}


def oracle_sql() -> dict:
    return {"op6_license_scan": licenses.oracle(), "op12_conversation_repair": dialogue.oracle(), "op13_hard_negatives": hardneg.oracle()}
