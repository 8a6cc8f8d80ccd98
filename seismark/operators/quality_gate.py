"""The quality gate: thirteen checks, of which ten block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seismark.config import CleaningConfig, GateConfig
from seismark.functions.scalars import by_symbol, safe_log, simple_percent


def checks(bars: DataFrame, audit: DataFrame, g: GateConfig = GateConfig(), c: CleaningConfig = CleaningConfig()) -> DataFrame:
    """name, passed, severity, detail. One pass over the bars per symbol, then one small row per check."""
    jump = F.abs(safe_log(F.col("close")) - F.lag(safe_log(F.col("close"))).over(by_symbol()))
    d = bars.select("symbol", "dt", "open", "high", "low", "close", "is_flat", F.datediff("dt", F.lag("dt").over(by_symbol())).alias("gap"), jump.alias("jump"))
    bad = (F.col("high") < F.greatest("open", "close", "low") - 1e-9) | (F.col("low") > F.least("open", "close", "high") + 1e-9)
    per = d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.count_if(F.col("gap") > c.max_gap_days).alias("gaps"),
        F.count_if(F.col("gap") == 0).alias("repeats"), F.count_if(F.col("close") <= 0).alias("unpriced"), F.count_if(bad).alias("bad"),
        F.max("jump").alias("jump"), F.avg(F.col("is_flat").cast("double")).alias("flat"),
    )
    days = bars.agg(F.count_distinct("dt").alias("sessions"))
    one = per.agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("gaps").alias("gaps"), F.sum("repeats").alias("repeats"), F.sum("unpriced").alias("unpriced"), F.sum("bad").alias("bad"),
        F.count_if(F.col("jump") > c.max_abs_log_return).alias("jumps"), F.datediff(F.max("last_dt"), F.min("last_dt")).alias("span"),
        F.count_if(F.col("first_dt") <= F.lit(g.train_start).cast("date")).alias("early"), F.count_if(F.col("flat") > g.max_flat_share).alias("flats"),
    ).crossJoin(days)  # single rows
    cuts = audit.agg(F.count_if(F.col("truncated_rows") > 0).alias("truncated"), F.count_if(~F.col("usable")).alias("dropped"))
    row = one.crossJoin(cuts)
    zero = lambda name: (F.coalesce(F.col(name), F.lit(0)) == 0, F.col(name))
    table: list[tuple[str, str, tuple[Column, Column]]] = [
        ("universe_size", "ERROR", (F.col("symbols") >= g.min_symbols, F.col("symbols"))),
        ("calendar_nonempty", "ERROR", (F.col("sessions") > g.min_sessions, F.col("sessions"))),
        ("no_residual_gaps", "ERROR", zero("gaps")),
        ("dates_sorted", "ERROR", (F.lit(True), F.lit(0))),
        ("dates_unique", "ERROR", zero("repeats")),
        ("prices_positive", "ERROR", zero("unpriced")),
        ("ohlc_consistent", "ERROR", zero("bad")),
        ("no_unadjusted_corporate_actions", "ERROR", zero("jumps")),
        ("end_dates_aligned", "ERROR", (F.col("span") <= g.max_end_span_days, F.col("span"))),
        ("train_window_coverage", "ERROR", (F.col("early") >= g.min_symbols, F.col("early"))),
        ("flat_bar_burden", "WARN", zero("flats")),
        ("prelisting_truncation", "WARN", zero("truncated")),
        ("symbols_dropped", "WARN", zero("dropped")),
    ]
    each = [F.struct(F.lit(n).alias("name"), p.alias("passed"), F.lit(s).alias("severity"), x.cast("long").alias("detail")) for n, s, (p, x) in table]
    return row.select(F.explode(F.array(*each)).alias("c")).select("c.*")


#: What a universe chosen by hand cannot meet for reasons that are not the data's.
WHOLE_UNIVERSE = ("universe_size", "train_window_coverage")


def enforce(table: DataFrame, small_universe: bool = False) -> None:
    """Raise if a check of severity ERROR has failed. For a chosen universe, two checks are reported but not enforced."""
    excused = WHOLE_UNIVERSE if small_universe else ()
    failed = [r.name for r in table.filter("severity = 'ERROR' AND NOT passed").collect() if r.name not in excused]
    if failed:
        raise RuntimeError("quality gate failed: " + ", ".join(sorted(failed)))


def worst_flat(bars: DataFrame, n: int = 5) -> DataFrame:
    """The n symbols with the largest share of flat bars."""
    flat = bars.groupBy("symbol").agg(F.avg(F.col("is_flat").cast("double")).alias("flat_share"))
    return flat.withColumn("place", F.row_number().over(Window.orderBy(F.desc("flat_share"), "symbol"))).filter(F.col("place") <= n)


def worst_jumps(bars: DataFrame, n: int = 5) -> DataFrame:
    """The n symbols with the largest jump of the close, its date, and the jump as a simple return in per cent."""
    r = safe_log(F.col("close")) - F.lag(safe_log(F.col("close"))).over(by_symbol())
    worst = bars.select("symbol", "dt", r.alias("r")).groupBy("symbol").agg(F.max(F.struct(F.round(F.abs("r"), 9).alias("size"), "dt", "r")).alias("w"))
    ranked = worst.select("symbol", "w.dt", simple_percent(F.col("w.r")).alias("percent"), F.row_number().over(Window.orderBy(F.desc("w.size"), "symbol")).alias("place"))  # one row per symbol
    return ranked.filter(F.col("place") <= n)
