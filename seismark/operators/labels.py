"""Crash and rally labels, and how early alerts come. For evaluation only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seismark.config import LabelConfig
from seismark.functions.scalars import by_symbol, keyed_digest

#: Name, least and most sessions of lead.
LEAD_BUCKETS = (("10+", 10, 10_000), ("5-9", 5, 9), ("2-4", 2, 4), ("0-1", 0, 1))
HIT_HORIZONS = (0, 1, 2, 3, 5, 10)


def forward_drawdown(horizon: int) -> Column:
    """Worst close of the next bars against this one; a partial window at the tail."""
    return F.min("close").over(by_symbol().rowsBetween(1, horizon)) / F.col("close") - 1


def forward_runup(horizon: int) -> Column:
    return F.max("close").over(by_symbol().rowsBetween(1, horizon)) / F.col("close") - 1


def full_forward_drawdown(horizon: int) -> Column:
    """As forward_drawdown, but NULL unless all ``horizon`` bars are there."""
    w = by_symbol().rowsBetween(1, horizon)
    return F.when(F.count("close").over(w) == horizon, F.min("close").over(w) / F.col("close") - 1)


def label_days(bars: DataFrame, c: LabelConfig = LabelConfig(), index_symbol: str | None = None) -> DataFrame:
    """symbol, dt, pos (bar number), fwd_dd, fwd_up, is_crash, is_rally. An index crashes at its own, lesser fall."""
    d = bars.select("symbol", "dt", "close", (F.row_number().over(by_symbol()) - 1).alias("pos"))
    d = d.withColumns({"fwd_dd": forward_drawdown(c.horizon), "fwd_up": forward_runup(c.horizon)})
    false = F.lit(False)
    fall = F.when(F.col("symbol") == index_symbol, c.index_crash).otherwise(c.crash) if index_symbol else F.lit(c.crash)
    return d.withColumns({"is_crash": F.coalesce(F.col("fwd_dd") <= fall, false), "is_rally": F.coalesce(F.col("fwd_up") >= c.rally, false)}).drop("close")


def onsets(days: DataFrame, flag: str, min_gap: int = 10) -> DataFrame:
    """symbol, dt of flagged bars at least ``min_gap`` bars after the last one kept.

    A greedy choice is a fold, not a window: it runs over the flagged bars of
    one symbol only.
    """
    flagged = days.filter(flag).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("pos", "dt"))).alias("_f"))
    none = F.array().cast(dict(flagged.dtypes)["_f"])

    def keep(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        return F.when((F.size(acc) == 0) | (x["pos"] - last["pos"] >= min_gap), F.concat(acc, F.array(x))).otherwise(acc)

    kept = flagged.select("symbol", F.explode(F.aggregate("_f", none, keep)).alias("_o"))
    return kept.select("symbol", "_o.dt")


def label_events(bars: DataFrame, c: LabelConfig = LabelConfig(), index_symbol: str | None = None) -> DataFrame:
    """symbol, dt, kind of all onsets."""
    days = label_days(bars, c, index_symbol)
    kinds = [onsets(days, f"is_{k}", c.min_gap).withColumn("kind", F.lit(k)) for k in ("crash", "rally")]
    return kinds[0].unionByName(kinds[1])


def leads(alerts: DataFrame, events: DataFrame, calendar: DataFrame, lookback: int = 15) -> DataFrame:
    """symbol, dt of each onset on the calendar, lead: sessions since the earliest alert within ``lookback``, or NULL.

    An interval join made an equi-join: each onset asks for its few sessions.
    """
    on = events.select("symbol", "dt").join(calendar, "dt")
    asked = on.select("symbol", "dt", F.col("pos").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(lookback))).alias("back"))
    fired = alerts.select("symbol", "dt").distinct().join(calendar, "dt").select(F.col("symbol").alias("fsymbol"), F.col("pos").alias("fpos"))
    hit = asked.join(fired, (F.col("symbol") == F.col("fsymbol")) & (F.col("at") - F.col("back") == F.col("fpos")), "left")
    return hit.groupBy("symbol", "dt").agg(F.max(F.when(F.col("fpos").isNotNull(), F.col("back"))).alias("lead"))


def false_alarms(alerts: DataFrame, events: DataFrame, calendar: DataFrame, lookback: int = 15) -> DataFrame:
    """symbol, dt of alerts with no onset in the next ``lookback`` sessions."""
    fired = alerts.select("symbol", "dt").distinct().join(calendar, "dt")
    soon = events.select("symbol", "dt").join(calendar, "dt").select("symbol", F.col("pos").alias("opos"))
    near = soon.select("symbol", F.explode(F.sequence(F.col("opos") - lookback, F.col("opos"))).alias("pos")).distinct()
    return fired.join(near, ["symbol", "pos"], "left_anti").select("symbol", "dt")


def lead_report(alerts: DataFrame, events: DataFrame, calendar: DataFrame, lookback: int = 15) -> DataFrame:
    """One row: n_events, n_caught, n_signals, false_alarms, median_lead."""
    lead = leads(alerts, events, calendar, lookback)
    got = lead.agg(F.count(F.lit(1)).alias("n_events"), F.count("lead").alias("n_caught"), F.percentile("lead", 0.5).alias("median_lead"))
    fired = alerts.select("symbol", "dt").distinct().agg(F.count(F.lit(1)).alias("n_signals"))
    wrong = false_alarms(alerts, events, calendar, lookback).agg(F.count(F.lit(1)).alias("false_alarms"))
    return got.crossJoin(fired).crossJoin(wrong)  # three single rows


def lead_distribution(lead: DataFrame) -> DataFrame:
    bucket = F.lit("missed")
    for name, lo, hi in LEAD_BUCKETS:
        bucket = F.when(F.col("lead").between(lo, hi), name).otherwise(bucket)
    return lead.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def hit_rate(lead: DataFrame) -> DataFrame:
    """horizon, rate: share of all events caught with at most that lead."""
    each = lead.select("lead", F.explode(F.array(*map(F.lit, HIT_HORIZONS))).alias("horizon"))
    return each.groupBy("horizon").agg(F.avg(F.when(F.col("lead") <= F.col("horizon"), 1.0).otherwise(0.0)).alias("rate"))


def horizon_decay(bars: DataFrame, fired: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 5, 10), limit: float = -0.10) -> DataFrame:
    """horizon, base, given_signal, lift of a drawdown within full windows. ``fired``: symbol, dt, fired."""
    d = bars.select("symbol", "dt", "close", *[full_forward_drawdown(h).alias(f"d{h}") for h in horizons]).join(fired, ["symbol", "dt"], "left")
    rows = d.select("fired", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"d{h}").alias("dd")) for h in horizons])).alias("x")).select("fired", "x.*")
    bad = F.when(F.coalesce(F.col("dd") <= limit, F.lit(False)), 1.0).otherwise(0.0)
    on = F.coalesce("fired", F.lit(False))
    out = rows.groupBy("horizon").agg(F.avg(bad).alias("base"), F.avg(F.when(on, bad)).alias("given_signal"))
    return out.withColumn("lift", F.try_divide("given_signal", "base"))


def random_alerts(days: DataFrame, alerts: DataFrame, seed: int = 0) -> DataFrame:
    """As many days per symbol as ``alerts`` has, chosen by a keyed digest: the same on any cluster."""
    wanted = alerts.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("symbol").orderBy(keyed_digest(seed), "dt")
    return days.join(wanted, "symbol").withColumn("_k", F.row_number().over(order)).filter("_k <= _n").select("symbol", "dt")
