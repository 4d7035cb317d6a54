"""Queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.llm import byte_bpe, chat, common, decontaminate, langid, merkle, mixing, pieces, quality, rules, secret_scan, simhash, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str) -> Callable:
    def wrap(fn: Callable) -> Callable:
        QUERIES[name] = fn
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_quality_trees")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, forest).select(
        "doc_id", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op8_simhash_cover")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_latent_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op3_sentencepiece_spans")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "spans_sha256")


@query("op7_chat_format")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(rows))


@query("op5_url_vocabulary")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@query("op10_divergence_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = rules.judge(docs.select("doc_id", "text"), rules.references(docs))
    return judged.select("doc_id", *rules.BASE, "base_failed", "kept", "class_distance", "word_distance")


SQL["op10_divergence_rules"] = rules.oracle()
SQL["op1_secret_scan"] = secret_scan.oracle()
SQL["op7_chat_format"] = chat.SQL
SQL["op5_url_vocabulary"] = urls.oracle()


@query("op2_byte_gru_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", (common.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op6_context_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents"))


@query("op11_duckdb_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op12_merkle_manifest")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    halves = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.audit(docs, {"text": F.translate("text", "\n", "")}, halves)


SQL["op12_merkle_manifest"] = merkle.ORACLE


@query("op13_exact_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
