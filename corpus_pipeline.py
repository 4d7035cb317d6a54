"""A corpus pipeline of operators of ``riskspark.llm``; every stage reads what the last one wrote.

Each stage takes (spark, docs, sf_dir) and returns all columns of the documents but the last, which
returns (doc_id, ids, starts, ends, n_tokens): the tokens of the remaining, redacted documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark import session
from riskspark.llm import decontaminate, pieces, quality, secret_scan, similar


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled rows of its input, does not reject."""
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return quality.score(rows, forest).where("predicted = 1").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near copies (five-word shingles, similarity 0.8)."""
    return similar.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; ``n_chars`` follows the text."""
    found = secret_scan.with_spans(docs.select(F.struct(docs.columns).alias("_row"), "text"))
    text = secret_scan.redacted(F.col("_row.text"), F.col("spans"))
    held = {c: F.col("_row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        held["n_chars"] = F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("_row.n_chars"))
    return found.select(*[held[c].alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and original byte spans of every text."""
    return pieces.encode(docs.select("doc_id", "text")).select("doc_id", "ids", "starts", "ends", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality classifier", keep_quality), ("SimHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets), ("SentencePiece encoding", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = session.work_path(spark, f"corpus-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
