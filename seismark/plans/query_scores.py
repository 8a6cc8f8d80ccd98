"""Queries over intensities, labels and lead times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.functions.scalars import signal_strength
from seismark.operators import intensity, labels
from seismark.plans.base import K, _add, _b, _r
from seismark.plans.context import TRAIN_END, Context

_add("ecdf_intensity", lambda c: c.scored.select("symbol", "dt", "score", "intensity"), f"SELECT {K}, {_r('score', 'intensity')} FROM sc")
_add("ecdf_per_symbol", lambda c: intensity.ecdf_per_symbol(c.proxy, intensity.train_window(c.proxy, "1995-01-01", TRAIN_END)), f"""
SELECT {K}, {_r('score')}, {_r(intensity='''CASE WHEN score IS NULL THEN NULL WHEN (SELECT count(*) FROM train t WHERE t.symbol = s.symbol) >= 100
  THEN (SELECT count(*) FROM train t WHERE t.symbol = s.symbol AND t.score <= s.score)::DOUBLE / (SELECT count(*) FROM train t WHERE t.symbol = s.symbol) ELSE intensity END''')} FROM sc s""")
_add("intensity_band", lambda c: c.banded.select("symbol", "dt", "band"), f"SELECT {K}, band FROM banded")
_add("band_counts", lambda c: intensity.band_counts(c.scored), f"SELECT band, {_b(n='count(*)', symbols='count(DISTINCT symbol)')} FROM banded GROUP BY band")
_add("alert_rates", lambda c: intensity.alert_rates(c.scored.filter("dt >= '1999-01-01'")), f"""
SELECT {_b(high_alerts='h', declining='d')}, {_r(per_symbol_year='h / (s * y)', declining_share='d / greatest(h, 1)')} FROM (SELECT count(*) FILTER (band = 'High') AS h, count(*) FILTER (band = 'High' AND phase = 'AcceleratingDecline') AS d,
count(DISTINCT symbol) AS s, datediff('day', min(dt), max(dt)) / 365.25 AS y FROM banded WHERE dt >= DATE '1999-01-01')""")
_add("signal_strength", lambda c: c.scored.select("symbol", "dt", signal_strength(F.col("intensity"), F.col("slope_z")).alias("strength")), f"SELECT {K}, {_r(strength='coalesce(intensity, 0) * coalesce(abs(slope_z), 0)')} FROM sc")

# labels
_add("forward_drawdown", lambda c: c.label_days.select("symbol", "dt", "fwd_dd"), f"SELECT {K}, {_r('fwd_dd')} FROM lab")
_add("forward_runup", lambda c: c.label_days.select("symbol", "dt", "fwd_up"), f"SELECT {K}, {_r('fwd_up')} FROM lab")
_add("crash_onsets", lambda c: c.crashes, f"SELECT {K} FROM crasho")
_add("rally_onsets", lambda c: labels.onsets(c.label_days, "is_rally"), f"SELECT {K} FROM rallyo")
_add("label_events", lambda c: labels.label_events(c.bars), f"SELECT {K}, 'crash' AS kind FROM crasho UNION ALL SELECT {K}, 'rally' FROM rallyo")
_add("label_events_index", lambda c: labels.label_events(c.bars, index_symbol="Brand#1"), f"""
SELECT {K}, 'crash' AS kind FROM crasho WHERE symbol <> 'Brand#1' UNION ALL SELECT {K}, 'crash' FROM indexo UNION ALL SELECT {K}, 'rally' FROM rallyo""")
_add("lead_time", lambda c: labels.leads(c.alerts, c.crashes, c.days), f"SELECT {K}, {_b('lead')} FROM leads")
_add("lead_report", lambda c: labels.lead_report(c.alerts, c.crashes, c.days), f"SELECT {_b(n_events='count(*)', n_caught='count(lead)', n_signals='(SELECT count(*) FROM alerts)', false_alarms='(SELECT count(*) FROM falses)')}, {_r(median_lead='quantile_cont(lead, 0.5)')} FROM leads")
_add("false_alarms", lambda c: labels.false_alarms(c.alerts, c.crashes, c.days), f"SELECT {K} FROM falses")
_add("lead_distribution", lambda c: labels.lead_distribution(labels.leads(c.alerts, c.crashes, c.days)), "SELECT CASE WHEN lead >= 10 THEN '10+' WHEN lead >= 5 THEN '5-9' WHEN lead >= 2 THEN '2-4' WHEN lead >= 0 THEN '0-1' ELSE 'missed' END AS bucket, count(*) AS n FROM leads GROUP BY 1")
_add("hit_rate", lambda c: labels.hit_rate(labels.leads(c.alerts, c.crashes, c.days)), f"SELECT h::BIGINT AS horizon, {_r(rate='avg(CASE WHEN lead <= h THEN 1e0 ELSE 0e0 END)')} FROM leads, (SELECT unnest([0, 1, 2, 3, 5, 10]) AS h) GROUP BY h")
_fired = lambda c: c.scored.select("symbol", "dt", F.coalesce((F.col("intensity") >= 0.95) & (F.col("phase") == "AcceleratingDecline"), F.lit(False)).alias("fired"))
_add("horizon_decay", lambda c: labels.horizon_decay(c.bars, _fired(c)), f"""
SELECT {_b('horizon')}, {_r('base', 'given_signal', lift='CASE WHEN base > 0 THEN given_signal / base END')} FROM (SELECT h AS horizon, avg(b) AS base, avg(CASE WHEN f THEN b END) AS given_signal FROM (""" + " UNION ALL ".join(
    f"SELECT {h} AS h, CASE WHEN count(close) OVER f{h} = {h} AND min(close) OVER f{h} / close - 1 <= -0.1 THEN 1e0 ELSE 0e0 END AS b, coalesce(intensity >= 0.95 AND phase = 'AcceleratingDecline', false) AS f FROM bars JOIN sc USING (symbol, dt) WINDOW f{h} AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in (1, 2, 3, 5, 10)) + ") GROUP BY h)")


def _rule_skill(c: Context) -> DataFrame:
    days, out = c.scored.select("symbol", "dt"), None
    for name, hit in {"high_decline": (F.col("intensity") >= 0.99) & (F.col("phase") == "AcceleratingDecline"), "moderate_decline": (F.col("intensity") >= 0.95) & (F.col("phase") == "AcceleratingDecline"), "high": F.col("intensity") >= 0.99}.items():
        alerts = c.scored.filter(hit).select("symbol", "dt")
        chance = labels.random_alerts(days, alerts)
        got = [labels.leads(a, c.crashes, c.days).agg(F.avg(F.col("lead").isNotNull().cast("double")).alias(n)) for a, n in ((alerts, "recall"), (chance, "random_recall"))]
        one = got[0].crossJoin(got[1]).select(F.lit(name).alias("rule"), "recall", "random_recall", F.try_divide("recall", "random_recall").alias("skill"))
        out = one if out is None else out.unionByName(one)
    return out


_RULES = {"high_decline": "intensity >= 0.99 AND phase = 'AcceleratingDecline'", "moderate_decline": "intensity >= 0.95 AND phase = 'AcceleratingDecline'", "high": "intensity >= 0.99"}
_CAUGHT = "(SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM {} x JOIN cal d ON d.dt = x.dt WHERE x.symbol = o.symbol AND d.pos BETWEEN c.pos - 15 AND c.pos) THEN 1e0 ELSE 0e0 END) FROM crasho o JOIN cal c ON c.dt = o.dt)"
_add("rule_skill", _rule_skill, " UNION ALL ".join(f"""
SELECT rule, {_r('recall', 'random_recall', skill='CASE WHEN random_recall > 0 THEN recall / random_recall END')} FROM (
WITH a AS (SELECT symbol, dt FROM sc WHERE {hit}), n AS (SELECT symbol, count(*) AS n FROM a GROUP BY 1),
z AS (SELECT symbol, dt FROM (SELECT s.symbol, s.dt, n, row_number() OVER (PARTITION BY s.symbol ORDER BY md5(s.symbol || '|' || s.dt::VARCHAR || '|0'), s.dt) AS k FROM sc s JOIN n ON n.symbol = s.symbol) WHERE k <= n)
SELECT '{name}' AS rule, {_CAUGHT.format('a')} AS recall, {_CAUGHT.format('z')} AS random_recall)""" for name, hit in _RULES.items()))
