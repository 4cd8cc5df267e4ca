"""Queries of this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gateflow.llm.bpe import bpe_report
from gateflow.llm.chat import chat_report
from gateflow.llm.codes import vector_codes
from gateflow.llm.html_text import pages_report
from gateflow.llm.knn import knn_join
from gateflow.llm.lexical import ranked_search
from gateflow.llm.mixing import mixing_report
from gateflow.llm.perplexity import quality_rules
from gateflow.llm.phrases import fingerprints_against_next
from gateflow.llm.pii import pii_report
from gateflow.llm.quality import quality_report
from gateflow.llm.simhash import simhash_report
from gateflow.llm.tables import table
from gateflow.llm.toxicity import toxicity_report

Query = Callable[[SparkSession, str], DataFrame]

RANKS = "byte_bpe_50k.tiktoken"


def _over(name: str, report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: report(table(spark, folder, name))


def _with_labels(report: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: report(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


def _bpe(docs: DataFrame) -> DataFrame:
    return bpe_report(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def llm_queries() -> dict[str, Query]:
    return {
        "op1_chat_formatting": _over("conversations", chat_report),
        "op2_source_mixing": _over("documents", mixing_report),
        "op3_pii": _over("documents", pii_report),
        "op4_knn_join": _over("embeddings", knn_join),
        "op5_toxicity": _with_labels(toxicity_report),
        "op6_bpe": _over("documents", _bpe),
        "op7_quality_classifier": _with_labels(quality_report),
        "op8_quality_rules": _over("documents", quality_rules),
        "op9_html_extraction": _over("pages", pages_report),
        "op10_simhash": _over("documents", simhash_report),
        "op11_vector_codes": _over("embeddings", vector_codes),
        "op12_ranked_search": lambda spark, folder: ranked_search(
            table(spark, folder, "documents"), table(spark, folder, "benchmark")
        ),
        "op13_document_fingerprints": _over("documents", fingerprints_against_next),
    }
