"""The registered queries of the training-data operators.

Each ``opN_`` query applies its operator, with production parameters, to the
whole of its table; ``SQL`` holds DuckDB equivalents where SQL can say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, langid, licenses, neighbours, packing, quality, runs, sessions, substrings, topk, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    fixed = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return chat.digests(chat.format_chats(turns))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_session_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.close_sessions(table(spark, sf_dir, "clicks"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    return runs.digests(runs.find_runs(docs))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_chat_format, op2_topk_search, op3_substring_dedup, op4_url_filter, op5_ngram_jaccard, op6_packing, op7_license_scan, op8_quality, op9_decontamination, op10_language_id, op11_session_closing, op12_periodic_runs, op13_nearest_neighbours)}

SQL: dict[str, str] = {"op1_chat_format": chat.SQL, "op2_topk_search": topk.SQL, "op3_substring_dedup": substrings.SQL, "op4_url_filter": urls.SQL, "op5_ngram_jaccard": jaccard.SQL, "op11_session_closing": sessions.SQL}
