"""The corpus pipeline: stages that filter, mix and encode the table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in
the shared folder and the next stage reads it again. All stages but the last return the
columns of documents; the last writes token files and returns one row per document from them.
Every stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackmill.llm import decontaminate, mixing, near_dups, tokens, toxicity
from trackmill.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents predicted toxic go; learnt from the labels of the documents given."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near copies the document with the smallest id stays."""
    return near_dups.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that contain a test item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents are drawn by rates up to 1, so no document is repeated, and as many tokens as meet the weights."""
    labels = mixing.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.draw(docs, mixing.fit(docs, labels, most=1.0, feasible=True))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token files, and what they hold of each document."""
    return tokens.tokens(docs, tokens.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: SQL cannot express the classifiers and the token ids; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(name, stage(spark, docs, sf_dir))
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
