"""Causal per-symbol features: a value at dt uses bars up to dt only.

All windows share one partitioning and order, so a plan has one exchange and
one sort however many features it computes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.config import FeatureConfig
from seismark.functions.scalars import by_symbol, guarded, rolling, safe_log, trailing


def slope_weights(n: int) -> list[float]:
    t = np.arange(n) - (n - 1) / 2
    return (t / (t**2).sum()).tolist()


def accel_weights(n: int) -> list[float]:
    """Twice the quadratic coefficient of a least-squares fit."""
    t = np.arange(n, dtype=float)
    return (2 * np.linalg.pinv(np.stack([np.ones(n), t, t**2], 1))[2]).tolist()


def dot(y: str, weights: list[float]) -> Column:
    """Weighted sum of the last values, oldest first; NULL if one is missing."""
    last = len(weights) - 1
    terms = [(F.col(y) if i == last else F.lag(y, last - i).over(by_symbol())) * w for i, w in enumerate(weights)]
    return sum(terms[1:], terms[0])


def with_returns(bars: DataFrame) -> DataFrame:
    logged = bars.withColumn("lc", safe_log(F.col("close")))
    return logged.withColumn("r", F.col("lc") - F.lag("lc").over(by_symbol()))


def rolling_slope(bars: DataFrame, window: int = 5) -> Column:
    return dot("lc", slope_weights(max(3, window))) * 100


def rolling_accel(bars: DataFrame, window: int = 7) -> Column:
    return dot("lc", accel_weights(max(3, window))) * 100


def theil_sen(y: str, window: int) -> Column:
    """Median of the pairwise slopes over the last bars; for small windows."""
    ys = F.collect_list(y).over(trailing(window))
    spots = F.sequence(F.lit(0), F.lit(window - 1))
    slopes = F.flatten(
        F.transform(spots, lambda i: F.transform(F.filter(spots, lambda j: j > i), lambda j: (F.get(ys, j) - F.get(ys, i)) / (j - i)))
    )
    n = window * (window - 1) // 2
    ordered = F.sort_array(slopes)
    middle = (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2
    return F.when(F.size(ys) == window, middle)


def realized_vol(n: int = 60) -> Column:
    """Standard deviation of r over n bars; lag it in a later stage."""
    return rolling(F.stddev_samp("r"), F.col("r"), n)


def phase(slope_z: Column, accel_z: Column, c: FeatureConfig = FeatureConfig()) -> Column:
    moving = (F.abs(slope_z) >= c.slope_deadband) & (F.abs(accel_z) >= c.accel_deadband)
    return (
        F.when(slope_z.isNull() | accel_z.isNull(), F.lit(None).cast("string"))
        .when(~moving, "Flat")
        .when((slope_z < 0) & (accel_z < 0), "AcceleratingDecline").when(slope_z < 0, "DeceleratingDecline")
        .when(accel_z > 0, "AcceleratingAdvance").otherwise("DeceleratingAdvance")
    )


def slope_accel(bars: DataFrame, c: FeatureConfig = FeatureConfig()) -> DataFrame:
    """symbol, dt, ret_1d, slope, accel, vol, slope_z, accel_z, phase."""
    d = with_returns(bars).withColumns({"slope": rolling_slope(bars, c.slope_window), "accel": rolling_accel(bars, c.accel_window), "sd": realized_vol(c.vol_window)})
    d = d.withColumn("vol", F.lag("sd", c.vol_lag).over(by_symbol()) * 100)
    d = d.withColumns({"slope_z": guarded(F.col("slope"), F.col("vol")), "accel_z": guarded(F.col("accel"), F.col("vol"))})
    return d.select("symbol", "dt", (F.col("r") * 100).alias("ret_1d"), "slope", "accel", "vol", "slope_z", "accel_z", phase(F.col("slope_z"), F.col("accel_z"), c).alias("phase"))


def precursors(bars: DataFrame, c: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The model's ten features, with ret_1d, vol_short, vol_long, vol and phase.

    ``bars`` needs is_flat. Three window stages: lags, rolling aggregates, and
    aggregates of aggregates.
    """
    col, m, n, k = F.col, c.med_window, c.vol_window, c.min_obs
    d = with_returns(bars).withColumn("prev_close", F.lag("close").over(by_symbol()))
    dollar = col("close") * F.when(col("volume") > 0, col("volume").cast("double"))
    jump = F.abs(guarded(col("open"), col("prev_close")) - 1) > c.gap_threshold
    d = d.withColumns({
        "down2": F.pow(F.when(col("r") < 0, col("r")).otherwise(0.0), 2), "up2": F.pow(F.when(col("r") > 0, col("r")).otherwise(0.0), 2),
        "lv": safe_log(col("volume").cast("double")), "rng": F.when(~col("is_flat"), guarded(col("high") - col("low"), col("close"))),
        "jump": F.when(F.coalesce(jump, F.lit(False)), 1.0).otherwise(0.0), "impact": guarded(F.abs(col("r")), dollar),
        "slope": rolling_slope(bars, c.slope_window), "accel": rolling_accel(bars, c.accel_window),
    })
    d = d.withColumns({
        "sd5": realized_vol(c.short_vol), "sd20": realized_vol(m), "sd60": realized_vol(n),
        "dn": F.sqrt(rolling(F.avg("down2"), col("down2"), m)), "up": F.sqrt(rolling(F.avg("up2"), col("up2"), m)),
        "lv_m": rolling(F.avg("lv"), col("lv"), n, k), "lv_s": rolling(F.stddev_samp("lv"), col("lv"), n, k),
        "rng_m": rolling(F.avg("rng"), col("rng"), n, k), "gap_freq": rolling(F.avg("jump"), col("jump"), m),
        "imp_m": rolling(F.avg("impact"), col("impact"), m), "top": rolling(F.max("close"), col("close"), n, k),
    })
    d = d.withColumns({
        "vol": F.lag("sd60", c.vol_lag).over(by_symbol()) * 100,
        "vv_s": rolling(F.stddev_samp("sd20"), col("sd20"), n), "vv_m": rolling(F.avg("sd20"), col("sd20"), n),
    })
    d = d.withColumns({"slope_z": guarded(col("slope"), col("vol")), "accel_z": guarded(col("accel"), col("vol"))})
    return d.select(
        "symbol", "dt", (col("r") * 100).alias("ret_1d"), (col("sd5") * 100).alias("vol_short"), (col("sd60") * 100).alias("vol_long"),
        guarded(col("sd5"), col("sd60")).alias("vol_ratio"), guarded(col("vv_s"), col("vv_m")).alias("vol_of_vol"),
        guarded(col("dn") - col("up"), col("dn") + col("up")).alias("semidev_asym"), guarded(col("lv") - col("lv_m"), col("lv_s")).alias("volume_z"),
        guarded(col("rng"), col("rng_m")).alias("range_expansion"), "gap_freq", safe_log(col("imp_m")).alias("illiquidity"),
        (guarded(col("close"), col("top")) - 1).alias("dd_from_high"), "slope_z", "accel_z", phase(col("slope_z"), col("accel_z"), c).alias("phase"), "vol",
    )


def with_warmup(bars: DataFrame, days: DataFrame, start: str, sessions: int) -> DataFrame:
    """Bars from ``sessions`` calendar sessions before ``start`` on: enough for windows that long."""
    first = days.filter(F.col("dt") < start).orderBy(F.desc("dt")).limit(sessions).agg(F.min("dt")).first()[0]
    return bars.filter(F.col("dt") >= F.coalesce(F.lit(first), F.lit(start).cast("date")))
