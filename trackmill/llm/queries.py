"""Registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm import counts, decontaminate, infill, licenses, mixing, near_dups, neighbours, pages, phrases, substrings, suffixes, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_neighbours")
def op1_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return neighbours.nearest(vectors, vectors.filter("id % 100 = 0"))


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_substrings")
def op3_substrings(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query("op4_near_dups")
def op4_near_dups(spark, sf_dir):
    return near_dups.near_dups(table(spark, sf_dir, "documents"))


@query("op5_decontamination")
def op5_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_licenses", licenses.sql())
def op6_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op7_page_text")
def op7_page_text(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "text")


@query("op8_mixing")
def op8_mixing(spark, sf_dir):
    return mixing.mixing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_suffixes")
def op9_suffixes(spark, sf_dir):
    return suffixes.remove_earlier(table(spark, sf_dir, "documents"))


@query("op10_token_output")
def op10_token_output(spark, sf_dir):
    return tokens.tokens(table(spark, sf_dir, "documents"), tokens.tokenizer_path())


@query("op11_phrases", phrases.sql())
def op11_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_token_counts")
def op12_token_counts(spark, sf_dir):
    return counts.count_tokens(table(spark, sf_dir, "documents"), counts.tokenizer_path(), counts.spaces_and_case, apart=True)


@query("op13_infill", infill.sql())
def op13_infill(spark, sf_dir):
    return infill.digests(table(spark, sf_dir, "documents"))
