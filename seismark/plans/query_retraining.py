"""Queries over the forest, retraining schemes and the stress test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.config import RetrainConfig, WindowConfig
from seismark.operators import backtest, forest, intensity, retrain, signals
from seismark.plans.base import _add
from seismark.plans.context import TRAIN_END, Context

_AS = "1999-06-01"
_counts = lambda c, scheme: retrain.training_slice(c.features, _AS, scheme, c.market).agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")).withColumn("scheme", F.lit(scheme))
_add("training_slice", lambda c: _counts(c, "incremental").unionByName(_counts(c, "rolling")).unionByName(_counts(c, "vol_purged")), f"""
SELECT 'incremental' AS scheme, count(*) AS n, min(dt) AS first_dt, max(dt) AS last_dt FROM pre WHERE dt < DATE '{_AS}' UNION ALL
SELECT 'rolling', count(*), min(dt), max(dt) FROM pre WHERE dt < DATE '{_AS}' AND dt >= DATE '1996-06-01' UNION ALL
SELECT 'vol_purged', count(*), min(dt), max(dt) FROM pre WHERE dt < DATE '{_AS}' AND dt >= DATE '1996-06-01' AND dt NOT IN (SELECT dt FROM mk WHERE dispersion >
(SELECT quantile_cont(dispersion, 0.9) FROM mk WHERE dt IN (SELECT dt FROM pre WHERE dt < DATE '{_AS}' AND dt >= DATE '1996-06-01')) AND dt >= DATE '1996-06-01')""")
_add("walk_forward_blocks", lambda c: c.days.join(retrain.refit_dates(c.days, "1999-01-01", "2000-12-31"), (F.col("dt") >= F.col("as_of")) & (F.col("dt") < F.col("block_end"))).select("dt", "as_of"), "SELECT dt, as_of FROM cal JOIN refit ON dt >= as_of AND dt < block_end")
_add("ewma_sample", lambda c: retrain.training_slice(c.features, _AS, "ewma").select("symbol", "dt"), f"""
SELECT symbol, dt FROM (SELECT symbol, dt, datediff('day', dt, DATE '{_AS}') * ln(0.994e0) - ln(-ln((('0x' || substr(md5(symbol || '|' || dt::VARCHAR || '|{_AS}|0'), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0)) AS key
FROM pre WHERE dt < DATE '{_AS}') QUALIFY row_number() OVER (ORDER BY key DESC, symbol, dt) <=
(SELECT least(count(*), greatest(CAST(floor(4 * count(DISTINCT symbol) / (1 - 0.994e0)) AS BIGINT), 5000)) FROM pre WHERE dt < DATE '{_AS}')""")


def _forest(c: Context) -> DataFrame:
    fitted = forest.fit(intensity.train_window(c.features, "1995-01-01", TRAIN_END))
    return forest.score(c.features, fitted).select("symbol", "dt", "score", "intensity")


_BLOCKS = ("1999-01-01", "2000-12-31")


def _walk(c: Context, scheme: str) -> DataFrame:
    """All refits of the backtest with the model and schedule of production."""
    if scheme not in c.walks:
        walked = retrain.walk_forward(c.features, retrain.refit_dates(c.days, *_BLOCKS), scheme, c.market)
        c.walks[scheme] = walked.persist()
    return c.walks[scheme]


def _walk_signals(c: Context, scheme: str) -> DataFrame:
    return signals.generate(c.features.join(_walk(c, scheme).select("symbol", "dt", "intensity"), ["symbol", "dt"]), "not_declining")


_period = lambda df: df.filter(F.col("dt").between(*_BLOCKS))
_YEARS = WindowConfig("1995-01-01", TRAIN_END, *_BLOCKS).backtest_years
_add("isolation_forest", _forest)
_add("walk_forward", lambda c: _each(lambda s: _walk(c, s).select(F.lit(s).alias("scheme"), "symbol", "dt", "as_of", "score", "intensity")))


def _each(make: Callable[[str], DataFrame]) -> DataFrame:
    """What ``make`` gives for every retraining scheme, one below the other."""
    parts = [make(s) for s in RetrainConfig().schemes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _schemes(c: Context) -> DataFrame:
    returns = _period(c.returns)
    flat = signals.performance(signals.equal_weight(returns.withColumn("in_position", F.lit(True))), _YEARS).select(F.col("max_drawdown").alias("bh_max_drawdown"))
    n = c.bars.select("symbol").distinct().count()

    def one(scheme: str) -> DataFrame:
        made = _walk_signals(c, scheme)
        held = returns.join(made.select("symbol", "dt", "in_position"), ["symbol", "dt"], "left")
        use = retrain.coverage(made, n, _YEARS, scheme).select("scheme", F.col("per_symbol_year").alias("trades_per_symbol_year"))
        days = _walk(c, scheme).agg(F.count_if(F.col("intensity") >= 0.99).alias("high_band_days"))
        return use.crossJoin(days).crossJoin(signals.performance(signals.equal_weight(held), _YEARS)).crossJoin(flat)  # single rows

    return retrain.scheme_results(_each(one))


def _scheme_coverage(c: Context) -> DataFrame:
    n = c.bars.select("symbol").distinct().count()
    return _each(lambda s: retrain.coverage(_walk_signals(c, s), n, _YEARS, s))


_add("scheme_comparison", _schemes)
_add("scheme_coverage", _scheme_coverage)
_add("scheme_by_symbol", lambda c: _each(lambda s: retrain.per_symbol(_walk_signals(c, s), _period(c.bars), s)))


def _stress(c: Context) -> DataFrame:
    """A forest fitted up to the end of 1997, then a quarter, a year and the rest, none of which it has seen."""
    fitted = forest.fit(intensity.train_window(c.features, "1995-01-01", "1997-12-31"))
    scored = forest.score(c.features.filter("dt >= '1998-01-01'"), fitted).join(c.frame.select("symbol", "dt", "regime"), ["symbol", "dt"]).persist()
    windows = {"quarter": ("1998-02-01", "1998-04-30"), "year": ("1998-01-01", "1998-12-31"), "rest": ("1999-01-01", "2001-12-31")}
    rule = signals.best_rule(signals.compare_reentry(c.frame, c.returns, 5.0))
    return signals.stress(scored, c.returns, windows, rule)


_add("stress_test", _stress)
