"""Queries over bars: cleaning, alignment and the quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.config import GateConfig
from seismark.operators import alignment, cleaning, quality_gate
from seismark.plans.base import K, OHLC, R, _add, _b, _r
from seismark.plans.context import CLEANING, Context

_add("scan_symbols", lambda c: c.bars.select("symbol").distinct(), "SELECT DISTINCT symbol FROM bars")
_add("dedupe_keep_last", lambda c: cleaning.dedupe(c.raw).select("symbol", "dt", *OHLC, "seq"), f"SELECT {K}, {_r(*OHLC)}, {_b('seq')} FROM dd1")
_add("valid_price_filter", lambda c: cleaning.valid_prices(cleaning.dedupe(c.raw)).select("symbol", "dt", *OHLC), f"SELECT {K}, {_r(*OHLC)} FROM valid")
_valid = lambda c: cleaning.valid_prices(cleaning.dedupe(c.raw))
_add("gap_truncation", lambda c: cleaning.breaks(_valid(c)).select("symbol", "first_dt", "gap_dt", "n_gaps"), f"SELECT symbol, first_dt, gap_dt, {_b('n_gaps')} FROM brk")
_add("corp_action_break", lambda c: cleaning.breaks(_valid(c)).select("symbol", "action_dt", "n_corp_actions"), f"SELECT symbol, action_dt, {_b('n_corp_actions')} FROM brk")
_FLAGS = "is_flat, is_zero_vol, gap_filled"
_add("clean_bars", lambda c: cleaning.clean(c.raw), f"SELECT {K}, {_r(*OHLC)}, {_b('volume')}, {_FLAGS} FROM cleaned")
_add("quality_flags", lambda c: c.flagged.select("symbol", "dt", "is_flat", "is_zero_vol", "gap_filled"), f"SELECT {K}, is_flat, volume = 0 AS is_zero_vol, false AS gap_filled FROM ret")
_add("load_index", lambda c: cleaning.clean(c.raw.filter("symbol = 'Brand#1'")), f"SELECT {K}, {_r(*OHLC)}, {_b('volume')}, {_FLAGS} FROM cleaned WHERE symbol = 'Brand#1'")
_add("load_universe", lambda c: cleaning.universe(c.raw, config=CLEANING).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("dt").alias("last_dt")),
     f"SELECT symbol, {_b(bars='count(*)')}, max(dt) AS last_dt FROM cleaned GROUP BY symbol HAVING count(*) >= 200")
_add("data_audit", lambda c: cleaning.audit(c.raw, CLEANING), f"""
SELECT r.symbol, {_b('raw_rows', kept_rows='coalesce(kept_rows, 0)', truncated_rows='coalesce(v, 0) - coalesce(kept_rows, 0)', n_gaps='coalesce(n_gaps, 0)', n_corp_actions='coalesce(n_corp_actions, 0)',
  flat_bars='coalesce(flat_bars, 0)', zero_volume='coalesce(zero_volume, 0)', dropped_bad_price='o - coalesce(v, 0)', dropped_duplicates='raw_rows - o')}, first_valid, coalesce(kept_rows, 0) >= 200 AS usable,
  CASE WHEN coalesce(v, 0) = 0 THEN 'no valid price rows' WHEN coalesce(kept_rows, 0) < 200 THEN 'only ' || coalesce(kept_rows, 0) || ' bars' ELSE '' END AS reason,
  CASE WHEN gap_dt IS NULL AND action_dt IS NULL THEN 'none' WHEN action_dt IS NULL OR gap_dt > action_dt THEN 'gaps' ELSE 'corporate action' END AS cause
FROM (SELECT symbol, count(*) AS raw_rows FROM raw GROUP BY 1) r LEFT JOIN (SELECT symbol, count(*) AS o FROM dd1 GROUP BY 1) USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS v FROM valid GROUP BY 1) USING (symbol)
LEFT JOIN brk USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS kept_rows, min(dt) AS first_valid, count(*) FILTER (is_flat) AS flat_bars, count(*) FILTER (is_zero_vol) AS zero_volume FROM cleaned GROUP BY 1) USING (symbol)""")
_add("trading_calendar", lambda c: c.days, f"SELECT dt, {_b('pos')} FROM cal")
_add("close_panel", lambda c: alignment.panel(c.bars, c.days, "close").select("symbol", "dt", "close"), f"SELECT {K}, {_r('close')} FROM panel")
_add("position_panel", lambda c: alignment.positions(c.signals, c.bars, c.days), "SELECT g.symbol, g.dt, coalesce(in_position, true) AS in_position FROM grid g LEFT JOIN sig s ON s.symbol = g.symbol AND s.dt = g.dt")
_add("listing_mask", lambda c: alignment.listing_mask(c.bars, c.days), f"SELECT {K}, is_listed FROM mask")
_add("stale_price_valuation", lambda c: alignment.last_known(c.bars, c.days), f"SELECT {K}, {_r('close', last_close='last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)')} FROM panel")
_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def _wide(c: Context) -> DataFrame:
    symbols = sorted((r.symbol for r in c.bars.select("symbol").distinct().collect()), key=lambda x: int(x.split("#")[1]))  # the columns
    return alignment.pivot(c.bars, "close", symbols).select("dt", *[F.col(f"`{x}`").alias(x.replace("Brand#", "b")) for x in symbols])


_add("panel_pivot", _wide, "SELECT dt, " + ", ".join(R.format(f"max(CASE WHEN symbol = '{x}' THEN close END)", x.replace("Brand#", "b")) for x in _BRANDS) + " FROM bars GROUP BY dt")
_GATE = GateConfig(min_symbols=20, min_sessions=100, train_start="1996-12-31")
_FAIL = lambda cond: f"coalesce((SELECT sum(CASE WHEN {cond} THEN 1 ELSE 0 END) FROM gd), 0)"
_add("quality_gate", lambda c: quality_gate.checks(cleaning.clean(c.raw), cleaning.audit(c.raw, CLEANING), _GATE), f"""
SELECT name, passed, severity, detail::BIGINT AS detail FROM (
WITH gd AS (SELECT *, datediff('day', lag(dt) OVER w, dt) AS gap, abs(ln(close) - lag(ln(close)) OVER w) AS jump FROM cleaned WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
per AS (SELECT symbol, min(dt) AS a, max(dt) AS z, count(*) AS n, max(jump) AS j, avg(CASE WHEN is_flat THEN 1e0 ELSE 0e0 END) AS f FROM gd GROUP BY 1),
x(name, severity, detail, lo, hi) AS (
SELECT 'universe_size', 'ERROR', (SELECT count(*) FROM per), 20, 1000000000 UNION ALL SELECT 'calendar_nonempty', 'ERROR', (SELECT count(DISTINCT dt) FROM gd), 101, 1000000000
UNION ALL SELECT 'no_residual_gaps', 'ERROR', {_FAIL('gap > 10')}, 0, 0 UNION ALL SELECT 'dates_sorted', 'ERROR', 0, 0, 0 UNION ALL SELECT 'dates_unique', 'ERROR', {_FAIL('gap = 0')}, 0, 0
UNION ALL SELECT 'prices_positive', 'ERROR', {_FAIL('close <= 0')}, 0, 0 UNION ALL SELECT 'ohlc_consistent', 'ERROR', {_FAIL('high < greatest(open, close, low) - 1e-9 OR low > least(open, close, high) + 1e-9')}, 0, 0
UNION ALL SELECT 'no_unadjusted_corporate_actions', 'ERROR', (SELECT count(*) FROM per WHERE j > 0.5), 0, 0 UNION ALL SELECT 'end_dates_aligned', 'ERROR', (SELECT datediff('day', min(z), max(z)) FROM per), 0, 7
UNION ALL SELECT 'train_window_coverage', 'ERROR', (SELECT count(*) FROM per WHERE a <= DATE '1996-12-31'), 20, 1000000000 UNION ALL SELECT 'flat_bar_burden', 'WARN', (SELECT count(*) FROM per WHERE f > 0.1), 0, 0
UNION ALL SELECT 'prelisting_truncation', 'WARN', (SELECT count(*) FROM (SELECT v.symbol, count(v.dt) AS v, max(coalesce(k, 0)) AS k FROM valid v LEFT JOIN (SELECT symbol, count(*) AS k FROM cleaned GROUP BY 1) USING (symbol) GROUP BY 1) WHERE v > k), 0, 0
UNION ALL SELECT 'symbols_dropped', 'WARN', (SELECT count(*) FROM (SELECT DISTINCT symbol FROM raw) LEFT JOIN per USING (symbol) WHERE coalesce(n, 0) < 200), 0, 0)
SELECT *, detail BETWEEN lo AND hi AS passed FROM x)""")
_add("flat_bar_worst", lambda c: quality_gate.worst_flat(c.flagged), f"SELECT symbol, {_r('flat_share')}, {_b('place')} FROM (SELECT *, row_number() OVER (ORDER BY flat_share DESC, symbol) AS place FROM (SELECT symbol, avg(CASE WHEN is_flat THEN 1e0 ELSE 0e0 END) AS flat_share FROM ret GROUP BY 1)) WHERE place <= 5")
_add("worst_jumps", lambda c: quality_gate.worst_jumps(_valid(c)), f"""
SELECT symbol, dt, {_r(percent='1e2 * (exp(r) - 1)')}, {_b('place')} FROM (SELECT *, row_number() OVER (ORDER BY size DESC, symbol) AS place FROM (SELECT symbol, dt, r, round(abs(r), 9) AS size FROM
(SELECT symbol, dt, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY dt) AS r FROM valid) WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY size DESC, dt DESC) = 1)) WHERE place <= 5""")
