"""Cross-sectional aggregates per date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seismark.functions.scalars import EPS, by_symbol, rolling, safe_log


def calendar_returns(panel: DataFrame) -> DataFrame:
    """r: log return between consecutive calendar rows; NULL across a gap."""
    lc = safe_log(F.col("close"))
    return panel.withColumn("lc", lc).withColumn("r", F.col("lc") - F.lag("lc").over(by_symbol()))


def average_correlation(panel: DataFrame, window: int = 60, min_symbols: int = 20) -> DataFrame:
    """dt, avg_corr by the variance identity: linear in the number of symbols."""
    r = calendar_returns(panel)
    port = r.groupBy("dt").agg(F.avg("r").alias("p"))
    days = Window.orderBy("dt").rowsBetween(-(window - 1), 0)  # one row per date
    port = port.select("dt", F.when(F.count("p").over(days) >= window, F.var_samp("p").over(days)).alias("var_p"))
    sd = r.withColumn("s", rolling(F.stddev_samp("r"), F.col("r"), window))
    sums = sd.groupBy("dt").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("s2"), F.count("s").alias("n"))
    den = F.col("s1") * F.col("s1") - F.col("s2")
    rho = (F.col("n") * F.col("n") * F.col("var_p") - F.col("s2")) / F.when(F.abs(den) > EPS, den)
    clipped = F.when(rho.isNotNull() & (F.col("n") >= min_symbols), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)))
    return sums.join(port, "dt").select("dt", clipped.alias("avg_corr"))


def exact_correlation(panel: DataFrame, window: int = 60) -> DataFrame:
    """dt, avg_corr: mean of all pair correlations of symbols complete in the window. Quadratic; for checks on few symbols."""
    r = calendar_returns(panel).select("symbol", "dt", "r")
    pairs = r.alias("a").join(r.alias("b"), (F.col("a.dt") == F.col("b.dt")) & (F.col("a.symbol") < F.col("b.symbol")))
    w = Window.partitionBy("s1", "s2").orderBy("dt").rowsBetween(-(window - 1), 0)
    both = pairs.select(F.col("a.symbol").alias("s1"), F.col("b.symbol").alias("s2"), F.col("a.dt").alias("dt"), F.col("a.r").alias("x"), F.col("b.r").alias("y"))
    full = (F.count("x").over(w) >= window) & (F.count("y").over(w) >= window)
    return both.select("dt", F.when(full, F.try_divide(F.covar_samp("x", "y").over(w), F.stddev_samp("x").over(w) * F.stddev_samp("y").over(w))).alias("c")).groupBy("dt").agg(F.avg("c").alias("avg_corr"))


def market_features(panel: DataFrame, features: DataFrame, mask: DataFrame, corr_window: int = 60, ma_window: int = 50, min_symbols: int = 20) -> DataFrame:
    """One row per date: n_live, breadths, median slope, dispersion, avg_corr, share below the moving average."""
    d = panel.join(features.select("symbol", "dt", "phase", "slope_z"), ["symbol", "dt"], "left").join(mask, ["symbol", "dt"], "left")
    on = F.coalesce("is_listed", F.lit(False))
    d = d.select("symbol", "dt", *[F.when(on, F.col(c)).alias(c) for c in ("close", "phase", "slope_z")])
    d = calendar_returns(d).withColumn("ma", rolling(F.avg("close"), F.col("close"), ma_window))
    live = F.count_if(F.col("phase").isNotNull() & (F.col("phase") != ""))
    down, up = F.count_if(F.col("phase") == "AcceleratingDecline"), F.count_if(F.col("phase") == "AcceleratingAdvance")
    both = F.col("close").isNotNull() & F.col("ma").isNotNull()
    by_dt = d.groupBy("dt").agg(
        live.alias("n_live"), (down * 100 / F.nullif(live, F.lit(0))).alias("breadth_decline"), (up * 100 / F.nullif(live, F.lit(0))).alias("breadth_advance"),
        F.percentile("slope_z", 0.5).alias("median_slope_z"), (F.stddev_samp("r") * 100).alias("dispersion"),
        (F.count_if(both & (F.col("close") < F.col("ma"))) * 100 / F.nullif(F.count_if(both), F.lit(0))).alias("pct_below_ma50"),
    )
    joined = by_dt.join(average_correlation(d.select("symbol", "dt", "close"), corr_window, min_symbols), "dt")
    floor = F.col("n_live") >= min_symbols
    names = ("breadth_decline", "breadth_advance", "median_slope_z", "dispersion", "avg_corr", "pct_below_ma50")
    return joined.select("dt", "n_live", *[F.when(floor, F.col(c)).alias(c) for c in names])


def symbol_floor(n: int) -> int:
    """min_symbols for a universe of n."""
    return min(20, max(3, n // 2))


def market_summary(market: DataFrame, columns: list[str]) -> DataFrame:
    """metric, p1, median, p99."""
    rows = market.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")
    q = rows.groupBy("metric").agg(F.percentile("x", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("q"))
    return q.select("metric", F.get("q", F.lit(0)).alias("p1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("p99"))


def purge_crisis_dates(market: DataFrame, quantile: float = 0.9, column: str = "dispersion") -> DataFrame:
    """Dates above the exact quantile of ``column``."""
    cut = market.agg(F.percentile(column, quantile).alias("_q"))
    return market.join(F.broadcast(cut), F.col(column) > F.col("_q")).select("dt")


def market_signal(market: DataFrame, breadth: float = 75.0, slope: float = -1.5) -> DataFrame:
    hit = (F.col("breadth_decline") >= breadth) & (F.col("median_slope_z") <= slope)
    return market.select("dt", F.coalesce(hit, F.lit(False)).alias("market_flag"))


def episodes(flags: DataFrame) -> DataFrame:
    """Runs of consecutive flagged dates: episode, start_dt, end_dt, sessions."""
    w = Window.orderBy("dt")  # one row per date
    start = F.col("market_flag") & ~F.coalesce(F.lag("market_flag").over(w), F.lit(False))
    runs = flags.withColumn("_s", start.cast("int")).withColumn("episode", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.filter("market_flag").groupBy("episode").agg(F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt"), F.count(F.lit(1)).alias("sessions"))
