"""Registered queries of the market-stress operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seismark.plans import query_bars, query_features, query_reports, query_retraining, query_scores, query_trading  # noqa: F401  they register their queries
from seismark.plans.base import REGISTRY
from seismark.plans.context import Context, tidy
from seismark.plans.oracle import with_ctes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(make: Callable[[Context], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: tidy(make(Context.of(spark, sf_dir)))

    return {name: bind(make) for name, (make, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(sql) for name, (_, sql) in REGISTRY.items() if sql}
