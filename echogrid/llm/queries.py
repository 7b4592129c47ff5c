"""One query an operator, over whole tables, with the columns that are fixed for it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, lm_scoring, mixing, packing, quality, secrets, simhash, templates, topk, toxicity, warc, whitening
from .common import shared_dir, table


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    back = chat.read_examples(chat.explode_examples(chat.format_conversations(rows.unionByName(extra))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), redacted=False)
    base = F.filter("spans", lambda x: x["kind"] != "owned")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans")
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _remainder("doc_id", 10) == 0)
    model = lm_scoring.fit(documents.where(~F.col("held_out")))
    return lm_scoring.score(documents, model, more={"doc_id": F.col("doc_id"), "held_out": F.col("held_out")})


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    # floor() makes finite longs of NaN and infinities, so what takes part is decided before it
    given = topk.valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    # scores are sums of doubles, exact while 64 products of two components stay below 2^53
    huge = F.raise_error(F.lit(f"a component is beyond {topk.EXACT} after scaling, so that scores would not be exact")).cast("double")
    vectors = given.select("id", F.transform("v", lambda x: F.when(F.abs(256 * x) < topk.EXACT, F.floor(256 * x).cast("double")).otherwise(huge)).alias("v"))
    found = topk.search(vectors, F.col("id") % 50 == 0, vec_id="id", vector="v")
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def _remainder(doc_id: str, divisor: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % divisor


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    chosen = _remainder("id", 5) != 0
    model = toxicity.fit(toxicity.train_rows(documents, table(spark, sf_dir, "labels"), chosen))
    scored = toxicity.score(documents, model, more={"doc_id": F.col("doc_id"), "held_out": _remainder("doc_id", 5) == 0})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_best_fit_packing,
        op3_quality_rules,
        op4_chat_formatting,
        op5_simhash_near_dedup,
        op6_source_mixing,
        op7_exact_top_k,
        op8_toxicity,
        op9_warc,
        op10_secret_scan,
        op11_embedding_whitening,
        op12_centroid_clustering,
        op13_html_extraction,
    )
}
