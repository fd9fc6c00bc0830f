"""A corpus pipeline of five stages, each an operator of ``tallyrail.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again before the next one. All but the last return the columns of ``documents``; other
columns of the input are carried along unread. Rows with a null doc_id stay in every stage that judges by doc_id.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrail.llm.lines import drop_boilerplate, text_lines
from tallyrail.llm.minhash import near_duplicates
from tallyrail.llm.packing import pack, token_pieces
from tallyrail.llm.quality import without_rejected
from tallyrail.llm.repeats import PASSAGE_WORDS, without_repeats


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't among the ids of ``gone``."""
    ids = gone.select(F.col("doc_id").alias("gone")).filter("gone IS NOT NULL").distinct()
    return docs.join(ids, docs["doc_id"] == ids["gone"], "left_anti")


def rewritten(docs: DataFrame, text) -> DataFrame:
    """docs with a new text, and n_chars to match where there is such a column."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the weak-label classifier rejects as junk or toxic."""
    return without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that are boilerplate within their source; documents stay, with the lines that are left."""
    found = drop_boilerplate(docs, F.col("source"), text_lines(F.col("text")))
    same = F.size("lines") == F.size("kept")
    text = F.when(same, F.col("row.text")).otherwise(F.array_join("kept", "\n")).alias("text")
    return rewritten(found.select(*[text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]), F.col("text"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id of each group of near duplicates."""
    return without(docs, near_duplicates(docs).filter("NOT kept"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove every byte of passages of ``PASSAGE_WORDS`` words, and of strings of op8's size, that occur more than
    once; documents stay, with what is left. The byte size holds for scripts that don't part words by spaces."""
    names = {c: f"d{k}_" for k, c in enumerate(docs.columns)}
    held = docs.select(F.struct(*[F.col(c).alias(a) for c, a in names.items() if c != "text"]).alias("row_"), "text")
    cut = without_repeats(held, key="row_", whole=True, words=PASSAGE_WORDS)
    out = cut.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"doc_id.{a}").alias(c) for c, a in names.items()])
    return rewritten(out, F.col("text")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality), ("line dedup", lines), ("near duplicates", near), ("repeats", repeats), ("packing", packing)]

#: SQL can't express the trained classifier, signatures, construction and tokenizer; tests compare each stage with a
#: brute-force version.
ORACLE_SQL = None


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one keeps is written to the checkpoint folder and read again. A stage's
    folder goes when the next one has been written; the last is read by the result."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    folder = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                removed(spark, f"{folder}/{k - 1}")
    return docs
