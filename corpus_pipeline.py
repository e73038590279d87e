"""From documents to tokens: quality, near duplicates, repeated passages, benchmark leaks, byte-pair encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm import bpe_stream, decontaminate, jaccard, ordinal, repeats, scratch

#: Bytes of a repeated passage that the pipeline cuts: just under fifty words of four bytes with a space each.
PASSAGE_BYTES = 240
TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose top grade (good and civil) is at least as likely as not."""
    ratings = ordinal.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal.select(docs, ordinal.train(docs, ratings))


def near_duplicates(_: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: that of the smallest id, then of the smallest text hash.

    Rows without an id or without words link with nothing and stay. Of rows that carry one id but texts that do not
    link, each group keeps its own. Of rows of a group that share id and text one stays: that whose other columns have
    the smallest hash.
    """
    found = jaccard.join(docs).filter("group_key is not null and doc_id is not null")
    first = found.groupBy("group_key").agg(F.min(F.struct("doc_id", "row_key")).alias("x")).select(F.col("x.doc_id").alias("own_id"), F.col("x.row_key").alias("own_key"))
    first = scratch.Table(first, "first-rows").read()
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")  # other columns may have any name
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), F.xxhash64(*docs.columns).alias("tie"), F.col("text").rlike(r"[^ \t-\r]").alias("worded"), row)
    linkable = F.col("id").isNotNull() & F.coalesce("worded", F.lit(False))
    same = rows.filter(linkable).join(first, (F.col("id") == F.col("own_id")) & (F.col("key") == F.col("own_key")), "left_semi")
    one = same.withColumn("place", F.row_number().over(Window.partitionBy("id", "key").orderBy("tie"))).filter("place = 1")
    return one.select("row.*").union(rows.filter(~linkable).select("row.*"))


def passages(_: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that also stand elsewhere."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = repeats.remove(docs, PASSAGE_BYTES, extra=rest)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(_: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its token count and the checksums of its ids and of the text decoded from them."""
    return bpe_stream.digest(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("leaks", leaks), ("tokens", tokens)]
#: A fitted model, alignments and byte-pair merges are no SQL; tests/llm/test_pipeline.py holds the whole run to plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written before the next reads it, and deleted once the next is written.

    The result reads the last stage's table: a caller who is done with it may call this inside scratch.kept().
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            now = scratch.Table(docs, f"stage-{name}")
            if before:
                before.drop()
            before, docs = now, now.read()
    return docs
