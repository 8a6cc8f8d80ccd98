"""Regime labels from rolling, causal percentiles."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.functions.scalars import rolling, trailing
from seismark.operators.features import with_returns


#: Returns and volatilities that differ by less are equal in exact arithmetic.
TOLERANCE = 1e-9


class RegimeDetector(Protocol):
    """Anything that adds ``regime`` to bars and looks back only."""

    def __call__(self, bars: DataFrame) -> DataFrame: ...


def realized_hv(window: int = 252) -> Column:
    return rolling(F.stddev_samp("r"), F.col("r"), window, max(window // 4, 20)) * F.sqrt(F.lit(252.0))


def _quantiles(x: str, qs: tuple[float, ...], lookback: int, warmup: int) -> Column:
    w = trailing(lookback)
    return F.when(F.count(x).over(w) >= warmup, F.percentile(x, F.array(*map(F.lit, qs))).over(w))


def _labels(x: Column, crash: Column, fall: Column, rise: Column, rally: Column) -> Column:
    over = lambda bound: x >= bound - TOLERANCE
    under = lambda bound: x <= bound + TOLERANCE
    return (
        F.when(x.isNull() | crash.isNull() | rally.isNull(), "Sideways")
        .when(over(rally), "Rally").when(over(rise), "Rising").when(under(crash), "Crashing").when(under(fall), "Falling").otherwise("Sideways")
    )


def detect(bars: DataFrame, mode: str = "per_symbol_percentile", reg_win: int = 20, lookback: int = 750, warmup: int = 250, hv_window: int = 252, vol_warmup: int = 60) -> DataFrame:
    """symbol, dt, pct_per_day, regime, hv, vol_regime. All quantiles of a column are taken in one pass."""
    d = with_returns(bars).withColumns({"pct_per_day": rolling(F.sum("r"), F.col("r"), reg_win) / reg_win * 100, "hv": realized_hv(hv_window)})
    x = F.col("pct_per_day")
    if mode == "per_symbol_percentile":
        d = d.withColumn("_q", _quantiles("pct_per_day", (0.05, 0.25, 0.75, 0.95), lookback, warmup))
        regime = _labels(x, *[F.get("_q", F.lit(i)) for i in range(4)])
    elif mode == "absolute":
        regime = _labels(x, F.lit(-0.20), F.lit(-0.05), F.lit(0.05), F.lit(0.20))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    d = d.withColumn("_v", _quantiles("hv", (0.33, 0.66), lookback, vol_warmup))
    low, high = F.get("_v", F.lit(0)), F.get("_v", F.lit(1))
    vol = F.when(F.col("hv").isNull() | low.isNull(), "MedVol").when(F.col("hv") <= low + TOLERANCE, "LowVol").when(F.col("hv") >= high - TOLERANCE, "HighVol").otherwise("MedVol")
    return d.select("symbol", "dt", "pct_per_day", regime.alias("regime"), "hv", vol.alias("vol_regime"))
