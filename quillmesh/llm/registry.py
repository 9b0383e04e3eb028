"""Queries of the training-data operators and their SQL, for the driver's entry module."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontaminate, language, lines, media, minhash, mixing, pii, sql, suffix, urls
from ._shared import table


def op1_suffix_dedup(spark, sf_dir):
    return suffix.suffix_report(table(spark, sf_dir, "documents")).drop("spans")


def op2_line_dedup(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"), exact_short=True)


def op3_media_columns(spark, sf_dir):
    return media.media_report(table(spark, sf_dir, "documents"))


def op4_personal_data(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def pii_base_spans(spark, sf_dir):
    """The base kinds of op4 alone, which SQL can express too."""
    return pii.pii_report(table(spark, sf_dir, "documents")).select("doc_id", *[f"n_{k}" for k in pii.BASE], "base_sha256")


def url_rules(spark, sf_dir):
    """Hosts, paths and rules of op6 alone: the verdict is null where no rule fits."""
    pages = urls.with_rules(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"))


def op10_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat_threads(spark, sf_dir):
    return chat.link_quotes(table(spark, sf_dir, "conversations"))


def op6_url_filters(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op7_source_mixing(spark, sf_dir):
    return mixing.mix_to_targets(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_line_dedup, op3_media_columns, op4_personal_data, op5_decontamination, op6_url_filters, op7_source_mixing, op8_language_id, op9_chat_threads, op10_near_duplicates, pii_base_spans, url_rules)}
ORACLES = sql.ORACLES
