"""Registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import in_reply_order, link_quotations
from .decontaminate import decontaminate
from .html_text import extract_pages
from .language import identify_languages
from .mixing import mix_documents
from .near_dedup import near_duplicates
from .oracle import ORACLE  # noqa: F401
from .pii import find_personal_data
from .quality import quality_rules
from .sharding import shard_documents
from .store import table
from .toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), similarity=85, bands=32, rows=8)


@query
def op4_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


@query
def op10_mixing(spark, sf_dir):
    return mix_documents(table(spark, sf_dir, "documents"))


@query
def op8_quality(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_html_text(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


@query
def op7_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_language(spark, sf_dir):
    return identify_languages(table(spark, sf_dir, "documents"))


@query
def op6_decontaminate(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_personal_data(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents"))


@query
def op5_chat(spark, sf_dir):
    return in_reply_order(link_quotations(table(spark, sf_dir, "conversations")))
