"""Alignment of symbols to one trading calendar; long, never wide."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(bars: DataFrame, index_symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """dt and its session position; of the index symbol, or of all symbols."""
    days = (bars.filter(F.col("symbol") == index_symbol) if index_symbol else bars).select("dt").distinct()
    days = days.filter(F.col("dt") >= start) if start else days
    days = days.filter(F.col("dt") <= end) if end else days
    # one row per session: the single ordered pass stays small
    return days.select("dt", (F.row_number().over(Window.orderBy("dt")) - 1).alias("pos"))


def lifetimes(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


def grid(bars: DataFrame, days: DataFrame) -> DataFrame:
    """Every session for every symbol: a sequence per symbol, not a join of two large sides."""
    sessions = days.agg(F.sort_array(F.collect_list(F.struct("pos", "dt"))).alias("_days"))
    symbols = bars.select("symbol").distinct()
    one = symbols.withColumn("_k", F.lit(1)).join(F.broadcast(sessions.withColumn("_k", F.lit(1))), "_k")
    return one.select("symbol", F.explode("_days").alias("_d")).select("symbol", "_d.dt", "_d.pos")


def panel(bars: DataFrame, days: DataFrame, *columns: str) -> DataFrame:
    """``columns`` on the full grid; gaps stay NULL."""
    return grid(bars, days).join(bars.select("symbol", "dt", *columns), ["symbol", "dt"], "left")


def listing_mask(bars: DataFrame, days: DataFrame) -> DataFrame:
    """is_listed: between the symbol's first and last bar."""
    return grid(bars, days).join(lifetimes(bars), "symbol").select("symbol", "dt", F.col("dt").between(F.col("first_dt"), F.col("last_dt")).alias("is_listed"))


def positions(signals: DataFrame, bars: DataFrame, days: DataFrame) -> DataFrame:
    """in_position on the full grid; a session without a signal is held."""
    on = grid(bars, days).join(signals.select("symbol", "dt", "in_position"), ["symbol", "dt"], "left")
    return on.select("symbol", "dt", F.coalesce("in_position", F.lit(True)).alias("in_position"))


def last_known(bars: DataFrame, days: DataFrame) -> DataFrame:
    """close, and the last known close for valuation only."""
    w = Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return panel(bars, days, "close").select("symbol", "dt", "close", F.last("close", ignorenulls=True).over(w).alias("last_close"))


def pivot(long: DataFrame, value: str, symbols: list[str]) -> DataFrame:
    """Wide, for export only."""
    return long.groupBy("dt").pivot("symbol", symbols).agg(F.first(value))
