"""Queries over drawdowns, report tables and chart frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from seismark.config import RetrainConfig
from seismark.operators import drawdown, intensity, report, signals
from seismark.plans.base import _add, _b, _r
from seismark.plans.query_retraining import _period, _walk_signals

_curve = lambda c: signals.equal_weight(c.held_returns)
_add("drawdown_series", lambda c: drawdown.series(_curve(c)), f"SELECT dt, {_r('equity', 'dd')} FROM ddc")
_add("drawdown_stats", lambda c: drawdown.stats(_curve(c)), f"""
SELECT {_r(max_drawdown='t.dd')}, p.dt AS max_dd_start, t.dt AS max_dd_trough, q.dt AS max_dd_recovered, (q.n - t.n)::BIGINT AS time_to_recover, (SELECT count(*) FROM ddc WHERE dd < -1e-9) AS days_under_water,
  coalesce((SELECT max(k) FROM (SELECT count(*) AS k FROM (SELECT dd, sum(CASE WHEN dd < -1e-9 THEN 0 ELSE 1 END) OVER (ORDER BY dt) AS g FROM ddc) WHERE dd < -1e-9 GROUP BY g)), 0)::BIGINT AS longest_underwater
FROM (SELECT *, row_number() OVER (ORDER BY dt) AS n FROM ddc ORDER BY dd, dt LIMIT 1) t
JOIN LATERAL (SELECT dt, equity FROM ddc d WHERE d.dt <= t.dt ORDER BY equity DESC, dt LIMIT 1) p ON true
LEFT JOIN LATERAL (SELECT dt, n FROM (SELECT *, row_number() OVER (ORDER BY dt) AS n FROM ddc) d WHERE d.dt >= t.dt AND d.equity >= p.equity ORDER BY dt LIMIT 1) q ON true""")
_BS = {"strategy_max_drawdown": "sdd", "bh_max_drawdown": "bdd", "drawdown_saved_pp": "1e2 * (sdd - bdd)", "strategy_return": "rs", "bh_return": "rb", "pct_days_in_cash": "pc"}
_add("drawdown_by_symbol", lambda c: drawdown.by_symbol(c.bars, c.signals).select("symbol", *_BS, "exits", "days_under_water", "bh_days_under_water"), f"SELECT symbol, {_r(**_BS)}, {_b('exits', days_under_water='us', bh_days_under_water='ub')} FROM ddsym")
_add("drawdown_summary", lambda c: drawdown.summary(drawdown.by_symbol(c.bars, c.signals)), f"""
SELECT count(*) AS n, count(*) FILTER (v > 0.1) AS helped, count(*) FILTER (v < -0.1) AS hurt, count(*) FILTER (exits = 0) AS untouched, {_r(mean_saved_pp='avg(v)', median_saved_pp='quantile_cont(v, 0.5)', best_saved_pp='max(v)', worst_saved_pp='min(v)')} FROM (SELECT *, 1e2 * (sdd - bdd) AS v FROM ddsym)""")
_add("cash_spells", lambda c: drawdown.cash_spells(c.signals), """
SELECT symbol, min(dt) AS start_dt, max(dt) AS end_dt, count(*) AS sessions FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) - row_number() OVER (PARTITION BY symbol, in_position ORDER BY dt) AS g FROM sig) WHERE NOT in_position GROUP BY symbol, g""")
_add("anomaly_days", lambda c: report.anomaly_days(c.scored, c.signals), f"""
SELECT s.symbol, s.dt, round(intensity, 4) AS intensity, CASE WHEN intensity >= 0.99 THEN 'Severe' ELSE 'Mild' END AS severity, round(slope_z, 2) + 0e0 AS slope, round(accel_z, 2) + 0e0 AS accel, phase AS trend,
CASE WHEN action = 'EXIT' THEN 'SELL' WHEN action = 'EXIT_WATCH' THEN 'SELL (from watch)' WHEN action = 'ENTER' THEN 'BUY' WHEN NOT in_position THEN 'already out' WHEN watching THEN 'watching' ELSE 'no action' END AS action
FROM sc s JOIN sig g ON g.symbol = s.symbol AND g.dt = s.dt WHERE intensity >= 0.95""")
_add("dashboard_payload", lambda c: report.dashboard_payload(c.bars, c.scored, c.signals), f"""
SELECT b.symbol, count(*) AS sessions, min(b.dt) AS first_dt, max(b.dt) AS last_dt, round(max_by(close, b.dt), 2) AS last_close, {_b(exits="count(*) FILTER (action IN ('EXIT', 'EXIT_WATCH'))", anomaly_days='count(*) FILTER (intensity >= 0.95)')},
round(1e2 * (1 - avg(CASE WHEN in_position THEN 1e0 ELSE 0e0 END)), 4) AS pct_in_cash FROM bars b JOIN sc s ON s.symbol = b.symbol AND s.dt = b.dt JOIN sig g ON g.symbol = b.symbol AND g.dt = b.dt GROUP BY b.symbol""")
_flat = lambda c: signals.equal_weight(c.returns.withColumn("in_position", F.lit(True)))
_add("chart_portfolio", lambda c: report.portfolio_chart(_curve(c), _flat(c)), f"""
SELECT dt, {_r(strategy='equity', strategy_dd='dd')}, {_r('benchmark', benchmark_dd='benchmark / max(benchmark) OVER (ORDER BY dt) - 1')} FROM ddc JOIN
(SELECT dt, exp(sum(ln(1 + d)) OVER (ORDER BY dt)) AS benchmark FROM (SELECT dt, coalesce(avg(ret), 0) AS d FROM hret GROUP BY dt)) USING (dt)""")
_add("chart_scatter", lambda c: report.scatter_chart(drawdown.by_symbol(c.bars, c.signals)), f"""
SELECT symbol, {_r(x='1e2 * bdd', y='1e2 * sdd')}, CASE WHEN 1e2 * (sdd - bdd) > 0.1 THEN 'shallower' WHEN 1e2 * (sdd - bdd) < -0.1 THEN 'deeper' ELSE 'unchanged' END AS side FROM ddsym""")
_add("chart_symbol", lambda c: report.symbol_chart(c.bars, c.signals, c.crashes), f"""
SELECT b.symbol, b.dt, {_r('close')}, NOT coalesce(in_position, true) AS in_cash, CASE WHEN action IN ('EXIT', 'EXIT_WATCH') THEN 'SELL' WHEN action = 'ENTER' THEN 'BUY' END AS marker, o.dt IS NOT NULL AS is_onset
FROM bars b LEFT JOIN sig s ON s.symbol = b.symbol AND s.dt = b.dt LEFT JOIN crasho o ON o.symbol = b.symbol AND o.dt = b.dt""")
_add("chart_schemes", lambda c: report.scheme_chart({s: signals.equal_weight(_period(c.returns).join(_walk_signals(c, s).select("symbol", "dt", "in_position"), ["symbol", "dt"], "left")) for s in RetrainConfig().schemes}))
