"""The registered queries of this package: operators bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embedding_dedup, html_text, langid, lm, quality, secrets, simhash, token_counts
from .common import held_out
from .oracles import oracle_sql  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("text"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = html_text.main_text(pages, into="text")
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out("doc_id", 10, 0)
    return lm.score(docs, lm.train(docs.filter(~out)), held_out=out)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out("doc_id", 4, 2)))
    out = langid.predict(docs.select("doc_id", "text"), model, into="language")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "language.*")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(docs, into="bpe").select("doc_id", "bpe.*")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train(docs), base="base", spans="all_spans")
    counts = [secrets.count_of("base", k).alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.span_text("base").cast("binary"), 256).alias("base_sha256"), secrets.span_text("all_spans").alias("spans"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id", 4, 2)))
    out = quality.score(docs, model, into="score").select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"), into="found")
    return found.select("doc_id", *[c.alias(k) for k, c in decontaminate.verdict("found").items()])


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_html_text": op2_html_text,
        "op3_lm": op3_lm,
        "op4_langid": op4_langid,
        "op5_bpe": op5_bpe,
        "op6_secrets": op6_secrets,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_quality": op8_quality,
        "op9_simhash": op9_simhash,
        "op10_decontaminate": op10_decontaminate,
    }
