"""A corpus pipeline over `documents`: each stage's rows are written as Parquet and read again for the next.

1. toxicity: documents scored one half or higher go.
2. line_dedup: lines that a smaller doc_id holds go; n_chars is counted anew.
3. simhash: of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles one stays; no pair is missed.
4. mixing: documents are taken up to each leaf's token budget, none twice.
5. pieces: texts become piece ids with merge-dropout.

Stages 1 to 4 return the columns doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import line_dedup, mixing, near_copies, pieces, toxicity
from quarry.llm.frames import shared_dir
from quarry.llm.queries import MIX, domain_of_source, table, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs, keep=("lang", "source"), min_chars=10)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs, width=5).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(MIX.weights, share=0.8, max_epochs=1, seed=MIX.seed)
    return mixing.mix_sources(docs, mix, domain_of_source()).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"), dropout=0.1, seed=11, as_array=True).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", without_toxic), ("line_dedup", without_repeated_lines), ("simhash", without_near_copies), ("mixing", mixed), ("pieces", encoded)]

#: Hashes, training and piece merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
