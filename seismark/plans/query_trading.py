"""Queries over signals, costs, the backtest and tax."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.config import SignalConfig
from seismark.functions.scalars import leg_cost, slippage
from seismark.operators import alignment, backtest, intensity, retrain, signals
from seismark.plans.base import K, _add, _b, _r
from seismark.plans.context import CAPITAL, Context

_add("reentry_mask", lambda c: c.scored.select("symbol", "dt", *[signals.reentry(r).alias(r) for r in signals.RULES]),
     f"SELECT {K}, coalesce(intensity >= 0.95 AND phase = 'AcceleratingAdvance', false) AS rally_signal, coalesce(phase = 'DeceleratingDecline', false) AS decel, true AS time, coalesce(phase, '') <> 'AcceleratingDecline' AS not_declining FROM sc")
_add("severe_signal", lambda c: c.frame.select("symbol", "dt", signals.severe().alias("severe")), f"SELECT {K}, sev AS severe FROM inp")
_add("severe_persistent", lambda c: c.frame.select("symbol", "dt", signals.severe(SignalConfig(exit_intensity=0.9, persistence=2)).alias("severe")),
     f"SELECT {K}, coalesce(h AND lag(h) OVER (PARTITION BY symbol ORDER BY dt), false) AS severe FROM (SELECT *, coalesce(intensity >= 0.9 AND phase = 'AcceleratingDecline', false) AS h FROM frame)")
_add("mild_signal", lambda c: c.frame.select("symbol", "dt", signals.mild().alias("mild")), f"SELECT {K}, mld AS mild FROM inp")
_add("watch_confirms", lambda c: c.frame.select("symbol", "dt", signals.watch_confirms(c.frame).alias("confirms")), f"SELECT {K}, conf AS confirms FROM inp")
_add("generate_signals", lambda c: c.signals, f"SELECT {K}, exit_signal, watching, reentry_ok, in_position, action FROM sig")
_add("equal_weight_equity", lambda c: signals.equal_weight(c.held_returns), f"SELECT dt, {_r('equity')} FROM eqw")
_add("performance", lambda c: signals.performance(signals.equal_weight(c.held_returns), 5.0), f"SELECT {_r(cagr='pow(max_by(equity, dt), 0.2e0) - 1', max_drawdown='min(dd)')} FROM ddc")
_add("reentry_comparison", lambda c: signals.compare_reentry(c.frame, c.returns, 5.0), " UNION ALL ".join(f"""
SELECT '{r}' AS rule, {_r('trades_per_sym_yr', 'cash_share', 'cagr', 'max_drawdown', 'bh_cagr', 'bh_max_drawdown')} FROM (
WITH h AS (SELECT r.symbol, r.dt, ret, coalesce(s.h0, true) AS held, coalesce(s.action, '') AS action FROM sret r JOIN (SELECT DISTINCT symbol FROM in{r}) m ON m.symbol = r.symbol LEFT JOIN rec{r} s ON s.symbol = r.symbol AND s.dt = r.dt),
e AS (SELECT dt, exp(sum(ln(1 + a)) OVER (ORDER BY dt)) AS a, exp(sum(ln(1 + b)) OVER (ORDER BY dt)) AS b FROM (SELECT dt, coalesce(avg(CASE WHEN held THEN ret WHEN ret IS NOT NULL THEN 0 END), 0) AS a, coalesce(avg(ret), 0) AS b FROM h GROUP BY dt)),
w AS (SELECT *, a / max(a) OVER (ORDER BY dt) - 1 AS da, b / max(b) OVER (ORDER BY dt) - 1 AS db FROM e)
SELECT (SELECT count(*) FILTER (action IN ('EXIT', 'EXIT_WATCH')) / (SELECT count(DISTINCT symbol) FROM bars)::DOUBLE / 5e0 FROM h) AS trades_per_sym_yr, (SELECT 1 - avg(CASE WHEN held THEN 1e0 ELSE 0e0 END) FROM h) AS cash_share,
pow(max_by(a, dt), 0.2e0) - 1 AS cagr, min(da) AS max_drawdown, pow(max_by(b, dt), 0.2e0) - 1 AS bh_cagr, min(db) AS bh_max_drawdown FROM w)""" for r in signals.RULES))
_add("contribution", lambda c: signals.contribution(c.returns, c.signals), f"""
SELECT symbol, {_r('edge_pp', share='abs(edge_pp) / nullif(sum(abs(edge_pp)) OVER (), 0)')}, {_b('exits')} FROM (SELECT symbol, 1e2 * (exp(sum(ln(1 + CASE WHEN held THEN coalesce(ret, 0) ELSE 0 END))) - exp(sum(ln(1 + coalesce(ret, 0))))) AS edge_pp,
count(*) FILTER (action IN ('EXIT', 'EXIT_WATCH')) AS exits FROM hret GROUP BY symbol)""")

# costs and backtest
_legs = lambda c: c.bars.join(c.features.select("symbol", "dt", "vol_ratio"), ["symbol", "dt"]).select("symbol", "dt", "close", "vol_ratio", F.when(F.dayofmonth("dt") % 2 == 0, "buy").otherwise("sell").alias("side"))
_SIDE = "CASE WHEN day(b.dt) % 2 = 0 THEN 'buy' ELSE 'sell' END"
_add("slippage", lambda c: _legs(c).select("symbol", "dt", "side", slippage(F.col("close"), F.col("side"), F.col("vol_ratio")).alias("fill")),
     f"SELECT b.symbol, b.dt, {_SIDE} AS side, {_r(fill=f'close * (1 + CASE WHEN day(b.dt) % 2 = 0 THEN 1 ELSE -1 END * least(5e-4 * (1 + greatest(coalesce(vol_ratio, 1) - 1, 0)), 1e-2))')} FROM bars b JOIN pre p ON p.symbol = b.symbol AND p.dt = b.dt")
_COSTS = ("notional", "brokerage", "exchange", "sebi", "gst", "stamp_duty", "stt", "dp_charge", "total_cost")
_add("leg_cost", lambda c: _legs(c).select("symbol", "dt", "side", leg_cost(F.col("side"), F.col("close"), F.lit(100), F.add_months("dt", 312)).alias("k")).select("symbol", "dt", "side", *[f"k.{x}" for x in _COSTS]), f"""
SELECT {K}, side, {_r(*_COSTS[:-1], total_cost='exchange + sebi + gst + stamp_duty + stt + dp_charge')} FROM (SELECT *, 1.8e-1 * (exchange + sebi) AS gst FROM (SELECT symbol, dt, {_SIDE} AS side, close * 1e2 AS notional, 0e0 AS brokerage, close * 1e2 * 1e-6 AS sebi,
close * 1e2 * CASE WHEN dt + INTERVAL 312 MONTH >= DATE '2024-10-01' THEN 2.97e-5 ELSE 3.25e-5 END AS exchange, CASE WHEN day(dt) % 2 = 0 THEN close * 1e2 * 1.5e-4 ELSE 0e0 END AS stamp_duty, close * 1e2 * 1e-3 AS stt,
CASE WHEN day(dt) % 2 = 1 THEN 1.534e1 ELSE 0e0 END AS dp_charge FROM bars b))""")


_equity = lambda c: backtest.equity(c.fold, alignment.last_known(c.bars, c.days), c.sleeve_capital)
_add("backtest_trades", lambda c: backtest.trades(c.fold), f"SELECT {K}, side, {_b('qty')}, {_r('price', 'total_cost')} FROM btrec WHERE side IS NOT NULL")
_add("backtest_equity", lambda c: _equity(c).select("dt", F.round("equity", 3).alias("equity")), f"SELECT dt, {_r(equity='round(equity, 3)')} FROM beq")
_add("realised_gains", lambda c: backtest.realised(c.fold), f"SELECT symbol, sold_on, {_b('qty', 'holding_days')}, {_r('gain')} FROM real")
_add("terminal_liquidation", lambda c: backtest.open_lots(c.fold, c.bars), f"SELECT symbol, sold_on, {_b('qty', 'holding_days')}, {_r('gain')} FROM lots")
_add("capital_gains", lambda c: backtest.capital_gains(backtest.realised(c.fold)), f"SELECT {_b('fy')}, {_r('stcg_gain', 'ltcg_gain', 'tax')} FROM tax")
_add("equity_after_tax", lambda c: backtest.after_tax(_equity(c), backtest.capital_gains(backtest.realised(c.fold))).select("dt", F.round("equity", 3).alias("equity")),
     f"SELECT dt, {_r(equity='round(equity - coalesce((SELECT sum(tax) FROM tax WHERE least(make_date(fy + 1, 3, 31), (SELECT max(dt) FROM beq)) <= e.dt), 0), 3)')} FROM beq e")


def _backtest_summary(c: Context) -> DataFrame:
    sales = backtest.realised(c.fold)
    paid = backtest.capital_gains(sales).agg(F.coalesce(F.sum("tax"), F.lit(0.0)).alias("tax_paid"))
    all_ = backtest.capital_gains(sales.unionByName(backtest.open_lots(c.fold, c.bars))).agg(F.coalesce(F.sum("tax"), F.lit(0.0)).alias("tax_liquidated"))
    use = backtest.trades(c.fold).agg(F.count(F.lit(1)).alias("trades"), F.sum("total_cost").alias("costs"))
    perf = signals.performance(_equity(c).withColumn("equity", F.col("equity") / CAPITAL), 5.0)
    cents = lambda *names: [F.round(n, 3).alias(n) for n in names]
    out = use.crossJoin(paid).crossJoin(all_).crossJoin(perf).withColumn("deferred_tax", F.col("tax_liquidated") - F.col("tax_paid"))  # single rows
    return out.select("trades", *cents("costs", "tax_paid", "tax_liquidated", "deferred_tax"), "cagr", "max_drawdown")


_add("backtest_summary", _backtest_summary, f"""
SELECT {_b('trades')}, {_r(costs='round(costs, 3)', tax_paid='round(p, 3)', tax_liquidated='round(a, 3)', deferred_tax='round(a - p, 3)')}, {_r('cagr', 'max_drawdown')} FROM
(SELECT count(*) AS trades, sum(total_cost) AS costs FROM btrec WHERE side IS NOT NULL), (SELECT coalesce(sum(tax), 0) AS p FROM tax), (SELECT coalesce(sum(tax), 0) AS a FROM taxall),
(SELECT pow(max_by(equity, dt) / 1e6, 0.2e0) - 1 AS cagr, min(dd) AS max_drawdown FROM (SELECT dt, equity, equity / max(equity) OVER (ORDER BY dt) - 1 AS dd FROM beq))""")
_add("refit_dates", lambda c: retrain.refit_dates(c.days, "1999-01-01", "2000-12-31"), "SELECT as_of, block_end FROM refit")
