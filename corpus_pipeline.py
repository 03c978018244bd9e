"""Corpus pipeline: quality, near duplicates, benchmark passages, source mix, shards.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept; every stage's
result is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfd.llm.decontam import contamination
from nearfd.llm.hilbert import hilbert_shards
from nearfd.llm.linecrf import score_quality, train
from nearfd.llm.mixing import mix_sources
from nearfd.llm.neardup import without_near_duplicates
from nearfd.llm.queries import HELD_OUT, LEVELS, SEED, SHARDS, THRESHOLD, domain_of, source_tree
from nearfd.llm.rules import word_array
from nearfd.session import materialize

MIX_SHARE = 0.8  # of the tokens that come in; every document is used at most once


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose line-labelled quality reaches the threshold; learned from the labels of its own input."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~F.expr(HELD_OUT))
    rows = docs.select(F.struct("*").alias("row"), "text")  # one column, so no name of the table can clash
    return score_quality(rows, model, keep=["row"]).filter(F.col("score") >= THRESHOLD).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; rows are told apart by id and text, so null and repeated ids do no harm."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_key=True)
    hit = materialize(found.select(F.struct("doc_id", "text_key").alias("hit")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"))  # one column, so no name of the table can clash
    key = F.struct(F.col("row.doc_id").alias("doc_id"), F.unhex(F.md5(F.coalesce("row.text", F.lit("")))).alias("text_key"))
    return rows.join(hit, key == F.col("hit"), "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fill the token budgets of the domain-language-source tree."""
    rows = docs.select(F.struct("*").alias("row"), domain_of(F.col("source")).alias("domain"), "lang", "source", "doc_id",
                       F.size(word_array(F.col("text"))).cast("long").alias("tokens"))
    tree = source_tree(rows)
    return mix_sources(rows, tree, LEVELS, "doc_id", "tokens", share=MIX_SHARE, max_epochs=1, seed=SEED).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``shard`` and ``slot`` along the Hilbert curve of language, source and length."""
    return hilbert_shards(docs, ["lang", "source", "n_chars"], SHARDS, "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: Learned models and sampled hashes cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
