"""From documents to token ids in five stages, each written and read again before the next.

Every stage takes all that the one before kept and returns the columns of documents, the last one the
ids' digests.  Rows stand for themselves: null texts pass through as null, repeated rows are answered
each, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import bpe, decontaminate, neardup, secrets, toxicity
from tallymill.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorization machine scores 0.5 or more."""
    machine = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, machine, keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8 similar): that of the smallest id.

    Rows of one id are one document and stay or go together; rows without an id stay.
    """
    gone = neardup.groups(docs, words_per_shingle=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of test items; a document that is mostly such passages goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    cleaned = decontaminate.clean(docs, benchmark, keep=("doc_id", "lang", "source"))
    return cleaned.where("not dropped").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    masked = secrets.redact(docs, keep=("doc_id", "lang", "source"))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of every document's byte-level BPE ids, and the digest of the decoded text."""
    return bpe.encode(docs, digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("secret scan", mask_secrets),
    ("byte-level BPE", encode),
]

#: Neither the classifier nor the tokenizer has an SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what every other stage keeps is written to the shared folder as Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
