"""Queries over features, the market and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from seismark.config import FEATURE_COLUMNS
from seismark.operators import alignment, features, market, regime
from seismark.plans.base import K, R, _add, _b, _r

_with = lambda c: features.with_returns(c.bars)
_add("rolling_slope", lambda c: _with(c).select("symbol", "dt", features.rolling_slope(c.bars).alias("slope")), f"SELECT {K}, {_r('slope')} FROM sa")
_add("rolling_accel", lambda c: _with(c).select("symbol", "dt", features.rolling_accel(c.bars).alias("accel")), f"SELECT {K}, {_r('accel')} FROM sa")
_pairs = ", ".join(f"(y{a} - y{b}) / {b - a}e0" for a in range(5) for b in range(a + 1, 5))
_add("theil_sen_slope", lambda c: _with(c).select("symbol", "dt", (features.theil_sen("lc", 5) * 100).alias("slope")),
     f"SELECT {K}, CASE WHEN y4 IS NOT NULL THEN {R.format('1e2 * list_median', 'x').replace('list_median', 'list_aggregate([' + _pairs + '], ' + chr(39) + 'median' + chr(39) + ')').removesuffix(' AS x')} END AS slope FROM (SELECT *, lc AS y0 FROM sa)")
_add("realized_vol", lambda c: _with(c).select("symbol", "dt", (features.realized_vol(60) * 100).alias("vol")), f"SELECT {K}, {_r(vol='1e2 * sd60')} FROM sa")
_add("classify_phase", lambda c: features.slope_accel(c.bars).groupBy("phase").agg(F.count(F.lit(1)).alias("n")), "SELECT phase, count(*) AS n FROM sa GROUP BY phase")
_add("slope_accel", lambda c: features.slope_accel(c.bars), f"SELECT {K}, {_r('slope', 'accel', 'vol', 'slope_z', 'accel_z', ret_1d='1e2 * r')}, phase FROM sa")
_FEATS = ("ret_1d", "vol_short", "vol_long", *FEATURE_COLUMNS, "vol")
_add("precursors", lambda c: c.features, f"SELECT {K}, {_r(*_FEATS)}, phase FROM pre")
_add("feature_coverage", lambda c: c.features.filter("dt >= '1996-01-01'").agg(*[F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in FEATURE_COLUMNS]),
     "SELECT " + _r(**{f: f"avg(CASE WHEN {f} IS NOT NULL THEN 1e0 ELSE 0e0 END)" for f in FEATURE_COLUMNS}) + " FROM pre WHERE dt >= DATE '1996-01-01'")
_MK = ("breadth_decline", "breadth_advance", "median_slope_z", "dispersion", "avg_corr", "pct_below_ma50")
_add("market_features", lambda c: c.market, f"SELECT dt, {_b('n_live')}, {_r(*_MK)} FROM mk")
_panel = lambda c: alignment.panel(c.bars, c.days, "close")
_add("avg_corr", lambda c: market.average_correlation(_panel(c), 5, 5), f"SELECT dt, {_r('avg_corr')} FROM corr")
_add("avg_corr_exact", lambda c: market.exact_correlation(_panel(c), 10), f"""
SELECT dt, {_r(avg_corr='avg(c)')} FROM (SELECT a.dt, CASE WHEN count(a.r) OVER w >= 10 AND count(b.r) OVER w >= 10 THEN covar_samp(a.r, b.r) OVER w / nullif(stddev_samp(a.r) OVER w * stddev_samp(b.r) OVER w, 0) END AS c
FROM pr a JOIN pr b ON a.dt = b.dt AND a.symbol < b.symbol WINDOW w AS (PARTITION BY a.symbol, b.symbol ORDER BY a.dt ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) GROUP BY dt""")
_add("market_features_full", lambda c: c.market_with(60, 50, market.symbol_floor(c.bars.select("symbol").distinct().count())), f"SELECT dt, {_b('n_live')}, {_r(*_MK)} FROM mkfull")
_add("avg_corr_full", lambda c: market.average_correlation(_panel(c), min_symbols=12), f"SELECT dt, {_r('avg_corr')} FROM corrfull")
_MS = ("breadth_decline", "median_slope_z", "dispersion")
_add("market_summary", lambda c: market.market_summary(c.market, list(_MS)), " UNION ALL ".join(f"SELECT '{m}' AS metric, {_r(p1=f'quantile_cont({m}, 0.01)', median=f'quantile_cont({m}, 0.5)', p99=f'quantile_cont({m}, 0.99)')} FROM mk" for m in _MS))
_add("purge_crisis_dates", lambda c: market.purge_crisis_dates(c.market), "SELECT dt FROM mk WHERE dispersion > (SELECT quantile_cont(dispersion, 0.9) FROM mk)")
_FLAG = "coalesce(breadth_decline >= 30 AND median_slope_z <= -0.2, false)"
_add("market_signal", lambda c: market.market_signal(c.market, 30.0, -0.2), f"SELECT dt, {_FLAG} AS market_flag FROM mk")
_add("market_signal_full", lambda c: market.market_signal(c.market), "SELECT dt, coalesce(breadth_decline >= 75 AND median_slope_z <= -1.5, false) AS market_flag FROM mk")
_add("market_episodes", lambda c: market.episodes(market.market_signal(c.market, 30.0, -0.2)), f"""
SELECT {_b('episode')}, min(dt) AS start_dt, max(dt) AS end_dt, count(*) AS sessions FROM (SELECT dt, f, sum(CASE WHEN f AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (ORDER BY dt) AS episode
FROM (SELECT dt, f, lag(f) OVER (ORDER BY dt) AS p FROM (SELECT dt, {_FLAG} AS f FROM mk))) WHERE f GROUP BY episode""")
_add("realized_hv", lambda c: _with(c).select("symbol", "dt", regime.realized_hv().alias("hv")), f"SELECT {K}, {_r('hv')} FROM rega")
_add("regime_absolute", lambda c: regime.detect(c.bars, "absolute", lookback=2, vol_warmup=1).select("symbol", "dt", "pct_per_day", "regime"), f"SELECT {K}, {_r(pct_per_day='ppd')}, regime FROM rega")
_rq = lambda x, q, k: f"CASE WHEN count({x}) OVER w >= {k} THEN quantile_cont({x}, {q}) OVER w END"


def _regime_sql(n: int, k: int) -> str:
    return f"""
SELECT {K}, CASE WHEN ppd IS NULL OR a IS NULL THEN 'Sideways' WHEN ppd >= d - 1e-9 THEN 'Rally' WHEN ppd >= c - 1e-9 THEN 'Rising' WHEN ppd <= a + 1e-9 THEN 'Crashing' WHEN ppd <= b + 1e-9 THEN 'Falling' ELSE 'Sideways' END AS regime
FROM (SELECT *, {_rq('ppd', 0.05, k)} AS a, {_rq('ppd', 0.25, k)} AS b, {_rq('ppd', 0.75, k)} AS c, {_rq('ppd', 0.95, k)} AS d FROM reg0 WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"""


_add("regime_labels", lambda c: regime.detect(c.bars, lookback=120, warmup=60).select("symbol", "dt", "regime"), _regime_sql(120, 60))
_add("regime_labels_full", lambda c: regime.detect(c.bars).select("symbol", "dt", "regime"), _regime_sql(750, 250))
_add("vol_regime", lambda c: regime.detect(c.bars, "absolute", lookback=120).select("symbol", "dt", "vol_regime"), f"""
SELECT {K}, CASE WHEN hv IS NULL OR a IS NULL THEN 'MedVol' WHEN hv <= a + 1e-9 THEN 'LowVol' WHEN hv >= b - 1e-9 THEN 'HighVol' ELSE 'MedVol' END AS vol_regime
FROM (SELECT *, {_rq('hv', 0.33, 60)} AS a, {_rq('hv', 0.66, 60)} AS b FROM reg0 WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 119 PRECEDING AND CURRENT ROW))""")
