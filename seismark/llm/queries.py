"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seismark.llm import chat, decontaminate, licenses, lines, packing, quality, sharding, simhash, toxicity, urls
from seismark.llm.common import small_batches, table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: [small_batches(spark), make(spark, sf_dir)][1]

    made = {
        "op1_quality_rules": lambda s, d: quality.op1_query(table(s, d, "documents")),
        "op2_chat_format": lambda s, d: chat.op2_query(table(s, d, "conversations")),
        "op3_sharding": lambda s, d: sharding.op3_query(table(s, d, "documents")),
        "op4_simhash": lambda s, d: simhash.op4_query(table(s, d, "documents")),
        "op5_license_scan": lambda s, d: licenses.op5_query(table(s, d, "documents")),
        "op6_decontaminate": lambda s, d: decontaminate.op6_query(table(s, d, "documents"), table(s, d, "benchmark")),
        "op7_line_dedup": lambda s, d: lines.op7_query(table(s, d, "documents")),
        "op8_url_filter": lambda s, d: urls.op8_query(table(s, d, "pages")),
        "op9_packing": lambda s, d: packing.op9_query(table(s, d, "documents")),
        "op10_toxicity": lambda s, d: toxicity.op10_query(table(s, d, "documents"), table(s, d, "labels")),
    }
    return {name: ready(make) for name, make in made.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.op1_sql(),
        "op2_chat_format": chat.op2_sql(),
        "op5_license_scan": licenses.op5_sql(),
        "op6_decontaminate": decontaminate.op6_sql(),
        "op7_line_dedup": lines.op7_sql(),
        "op8_url_filter": urls.op8_sql(),
    }
