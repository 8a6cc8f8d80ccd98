"""Cleaning of raw bars: dedupe, price filter, truncation, flags, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seismark.config import CleaningConfig
from seismark.functions.scalars import by_symbol, safe_log

PRICES = ("open", "high", "low", "close")
KEPT = ("symbol", "dt", *PRICES, "volume", "_source", "_dq_score", "_gap_filled")


def dedupe(raw: DataFrame) -> DataFrame:
    """The last row, by seq, of every symbol and date."""
    last = Window.partitionBy("symbol", "dt").orderBy(F.desc("seq"))
    return raw.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def valid_prices(bars: DataFrame) -> DataFrame:
    """Rows whose four prices are all above zero."""
    good = F.lit(True)
    for c in PRICES:
        good = good & (F.col(c) > 0)
    return bars.filter(good)


def _steps(bars: DataFrame, config: CleaningConfig) -> DataFrame:
    """``bars`` with _long (a long gap before the bar) and _jumped (an unadjusted jump to it)."""
    close = safe_log(F.col("close"))
    gap, jump = F.datediff("dt", F.lag("dt").over(by_symbol())), F.abs(close - F.lag(close).over(by_symbol()))
    return bars.withColumns({"_long": gap > config.max_gap_days, "_jumped": jump > config.max_abs_log_return})


def _last(flag: str) -> Column:
    return F.max(F.when(F.col(flag), F.col("dt")))


def breaks(bars: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Per symbol: first_dt, the bar after the last long gap, the last jump, and how many there are of each."""
    return _steps(bars, config).groupBy("symbol").agg(
        F.min("dt").alias("first_dt"), _last("_long").alias("gap_dt"), F.count_if("_long").alias("n_gaps"), _last("_jumped").alias("action_dt"), F.count_if("_jumped").alias("n_corp_actions"),
    )


def truncate(bars: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Bars from each symbol's last break on, up to the hard end; its windows share the symbol's partitioning."""
    whole = Window.partitionBy("symbol")
    start = F.greatest(F.min("dt").over(whole), _last("_long").over(whole), _last("_jumped").over(whole))
    return _steps(bars, config).withColumn("_start", start).filter((F.col("dt") >= F.col("_start")) & (F.col("dt") <= config.hard_end)).drop("_start", "_long", "_jumped")


def flagged(bars: DataFrame) -> DataFrame:
    """Kept columns and the flags is_flat, is_zero_vol, gap_filled. Nothing is dropped."""
    kept = bars.select(*[c for c in KEPT if c in bars.columns])
    filled = F.coalesce(F.col("_gap_filled").cast("boolean"), F.lit(False)) if "_gap_filled" in bars.columns else F.lit(False)
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    return kept.withColumns({"is_flat": flat, "is_zero_vol": F.coalesce("volume", F.lit(0)) == 0, "gap_filled": filled})


def clean(raw: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """The whole chain, all symbols at once. Dealt by symbol first, its windows need no other exchange."""
    return flagged(truncate(valid_prices(dedupe(raw.repartition("symbol"))), config))


def audit(raw: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """One row of counters per raw symbol, with the cause of any cut and why it is not usable."""
    one = dedupe(raw.repartition("symbol"))
    valid = valid_prices(one)
    found = breaks(valid, config)
    done = flagged(truncate(valid, config))
    n = F.count(F.lit(1))
    kept = done.groupBy("symbol").agg(
        n.alias("kept_rows"), F.min("dt").alias("first_valid"), F.count_if("is_flat").alias("flat_bars"), F.count_if("is_zero_vol").alias("zero_volume")
    )
    out = (
        raw.groupBy("symbol").agg(n.alias("raw_rows"))
        .join(one.groupBy("symbol").agg(n.alias("one")), "symbol", "left")
        .join(valid.groupBy("symbol").agg(n.alias("valid")), "symbol", "left")
        .join(found, "symbol", "left").join(kept, "symbol", "left")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    usable = zero("kept_rows") >= config.min_bars
    gap, action = F.col("gap_dt"), F.col("action_dt")
    cause = F.when(gap.isNull() & action.isNull(), "none").when(action.isNull() | (gap > action), "gaps").otherwise("corporate action")
    return out.select(
        "symbol", "raw_rows", zero("kept_rows").alias("kept_rows"), "first_valid", (zero("valid") - zero("kept_rows")).alias("truncated_rows"),
        zero("n_gaps").alias("n_gaps"), zero("n_corp_actions").alias("n_corp_actions"), zero("flat_bars").alias("flat_bars"),
        zero("zero_volume").alias("zero_volume"), (zero("one") - zero("valid")).alias("dropped_bad_price"),
        (F.col("raw_rows") - zero("one")).alias("dropped_duplicates"), usable.alias("usable"),
        F.when(zero("valid") == 0, "no valid price rows").when(~usable, F.format_string("only %d bars", zero("kept_rows"))).otherwise("").alias("reason"),
        cause.alias("cause"),
    )


def universe(raw: DataFrame, symbols: list[str] | None = None, usable_only: bool = True, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Cleaned bars of the chosen (by default all), usable symbols."""
    picked = raw if symbols is None else raw.filter(F.col("symbol").isin(asked_names(symbols)))
    bars = clean(picked, config)
    if not usable_only:
        return bars
    return bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).filter(F.col("_n") >= config.min_bars).drop("_n")


def asked_names(symbols: list[str]) -> list[str]:
    """Names as they are stored: without blanks around them, in upper case unless asked for as they are."""
    bare = [s.strip() for s in symbols]
    return sorted({*bare, *(s.upper() for s in bare)})


def load_symbol(raw: DataFrame, symbol: str, strict: bool = True, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Cleaned bars of one symbol. A symbol that the source lacks raises, and so does, if ``strict``, one that is not usable."""
    mine = raw.filter(F.col("symbol") == symbol)
    found = audit(mine, config).select("usable", "reason").collect()
    if not found:
        raise LookupError(f"no bars of {symbol!r}")
    if strict and not found[0].usable:
        raise ValueError(f"{symbol!r} is not usable: {found[0].reason}")
    return clean(mine, config)


def unknown_symbols(raw: DataFrame, symbols: list[str]) -> list[str]:
    """The names asked for that the source lacks."""
    asked = raw.sparkSession.createDataFrame([(s.strip(),) for s in symbols], "symbol string")
    return sorted(r.symbol for r in asked.join(raw.select(F.upper("symbol").alias("_u")).distinct(), F.upper("symbol") == F.col("_u"), "left_anti").collect())
