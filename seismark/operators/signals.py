"""Trading signals: predicates, the hold/cash state machine, equal-weight equity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seismark.config import SignalConfig
from seismark.functions.scalars import is_sell, rolling

#: Falls and slopes that differ by less are equal in exact arithmetic.
TOLERANCE = 1e-9
RULES = ("rally_signal", "decel", "time", "not_declining")


def reentry(rule: str, c: SignalConfig = SignalConfig()) -> Column:
    phase, intensity = F.col("phase"), F.col("intensity")
    masks = {
        "rally_signal": (intensity >= c.reentry_intensity) & (phase == "AcceleratingAdvance"),
        "decel": phase == "DeceleratingDecline",
        "time": F.lit(True),
        "not_declining": ~phase.eqNullSafe("AcceleratingDecline"),
    }
    if rule not in masks:
        raise ValueError(f"unknown re-entry rule {rule!r}")
    return F.coalesce(masks[rule], F.lit(False))


def severe(c: SignalConfig = SignalConfig()) -> Column:
    hit = F.coalesce((F.col("intensity") >= c.exit_intensity) & (F.col("phase") == "AcceleratingDecline"), F.lit(False))
    if c.persistence <= 1:
        return hit
    n = hit.cast("int")
    return F.coalesce(rolling(F.sum(n), n, c.persistence) >= c.persistence, F.lit(False))


def mild(c: SignalConfig = SignalConfig()) -> Column:
    inside = (F.col("intensity") >= c.moderate_intensity) & (F.col("intensity") < c.exit_intensity)
    return F.coalesce(inside, F.lit(False)) & ~F.col("phase").eqNullSafe("AcceleratingAdvance")


def watch_confirms(frame: DataFrame) -> Column:
    """Falls faster than its slope, in a falling regime (if there is one). Missing inputs count as zero."""
    zero = F.lit(0.0)
    fast = F.coalesce(F.col("ret_1d") / F.when(F.col("vol") > 0, F.col("vol")), zero) if {"ret_1d", "vol"} <= set(frame.columns) else zero
    slope = F.coalesce("slope_z", zero) if "slope_z" in frame.columns else zero
    falling = F.coalesce(F.col("regime").isin("Crashing", "Falling"), F.lit(False)) if "regime" in frame.columns else F.lit(True)
    return (fast < slope - TOLERANCE) & falling & (slope < -TOLERANCE)


def step(state: tuple[bool, int, int], is_severe: bool, is_mild: bool, confirms: bool, slope: float, may_return: bool, c: SignalConfig) -> tuple[tuple[bool, int, int], str]:
    """The next (holding, bars since the last change, watch days left) and the action taken."""
    holding, since, watch = state
    since += 1
    if not holding:
        if since > c.cooldown and (may_return or since >= c.max_cash_days):
            return (True, 0, watch), "ENTER"
        return (False, since, watch), ""
    if is_severe and since > c.min_hold:
        return (False, 0, 0), "EXIT"
    if watch > 0:
        if confirms and since > c.min_hold:
            return (False, 0, 0), "EXIT_WATCH"
        return (True, since, 0 if slope > 0 else watch - 1), ""
    return (True, since, c.watch_days if is_mild else watch), ""


START = (True, 10_000, 0)
SIGNALS = "symbol string, dt date, exit_signal boolean, watching boolean, reentry_ok boolean, in_position boolean, action string"


def prepared(frame: DataFrame, rule: str = "not_declining", c: SignalConfig = SignalConfig()) -> DataFrame:
    """symbol, dt and the inputs of the state machine, computed in the JVM."""
    return frame.select(
        "symbol", "dt", severe(c).alias("severe"), mild(c).alias("mild"), watch_confirms(frame).alias("confirms"),
        F.when(F.abs("slope_z") > TOLERANCE, F.col("slope_z")).otherwise(0.0).alias("slope"), reentry(rule, c).alias("reentry"),
    )


def generate(frame: DataFrame, rule: str = "not_declining", c: SignalConfig = SignalConfig()) -> DataFrame:
    """symbol, dt, exit_signal, watching, reentry_ok, in_position, action.

    A bar's position is stated before its decision, so decisions act on the
    next bar. State passes along one symbol's history, folded in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt", kind="stable")
        state, rows = START, []
        for s, m, w, slope, back in pdf[["severe", "mild", "confirms", "slope", "reentry"]].itertuples(index=False):
            held, watching = state[0], state[2] > 0
            state, action = step(state, s, m, w, slope, back, c)
            rows.append((held, watching, action))
        out = pdf[["symbol", "dt"]].copy()
        out["exit_signal"], out["reentry_ok"] = pdf["severe"], pdf["reentry"]
        out["in_position"], out["watching"], out["action"] = zip(*rows, strict=True)
        return out[["symbol", "dt", "exit_signal", "watching", "reentry_ok", "in_position", "action"]]

    return prepared(frame, rule, c).groupBy("symbol").applyInPandas(run, SIGNALS)


def equal_weight(returns: DataFrame) -> DataFrame:
    """dt, equity. ``returns``: symbol, dt, ret (simple, NULL if none), in_position. Cash earns nothing but stays in the mean."""
    gated = F.when(F.coalesce("in_position", F.lit(True)), F.col("ret")).when(F.col("ret").isNotNull(), 0.0)
    daily = returns.groupBy("dt").agg(F.coalesce(F.avg(gated), F.lit(0.0)).alias("d"))
    w = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    return daily.select("dt", F.exp(F.sum(F.ln(F.col("d") + 1)).over(w)).alias("equity"))


def performance(equity: DataFrame, years: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """cagr and max_drawdown, by ``keys`` if any."""
    w = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    d = equity.withColumn("_dd", F.col("equity") / F.max("equity").over(w) - 1)
    return d.groupBy(*keys).agg((F.pow(F.max_by("equity", "dt"), 1.0 / years) - 1).alias("cagr"), F.min("_dd").alias("max_drawdown"))


def simple_returns(panel: DataFrame) -> DataFrame:
    """symbol, dt, ret between consecutive calendar rows."""
    w = Window.partitionBy("symbol").orderBy("dt")
    return panel.select("symbol", "dt", (F.col("close") / F.lag("close").over(w) - 1).alias("ret"))


def long_enough(frame: DataFrame, min_bars: int) -> DataFrame:
    """The rows of symbols with ``min_bars`` rows or more."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return frame.withColumn("_n", n).filter(F.col("_n") >= min_bars).drop("_n")


def compare_reentry(frame: DataFrame, returns: DataFrame, years: float, c: SignalConfig = SignalConfig(), min_bars: int = 250) -> DataFrame:
    """rule, trades_per_sym_yr, cash_share, cagr, max_drawdown, bh_cagr, bh_max_drawdown of all four rules.

    Symbols with fewer than ``min_bars`` scored days take no part, but count among the symbols.
    """
    n = returns.select("symbol").distinct().count()
    part = long_enough(frame, min_bars)
    mine = returns.join(part.select("symbol").distinct(), "symbol", "left_semi")
    flat = performance(equal_weight(mine.withColumn("in_position", F.lit(True))), years).select(F.col("cagr").alias("bh_cagr"), F.col("max_drawdown").alias("bh_max_drawdown"))
    out = None
    for rule in RULES:
        held = mine.join(generate(part, rule, c), ["symbol", "dt"], "left").withColumn("in_position", F.coalesce("in_position", F.lit(True)))
        use = held.agg((F.count_if(is_sell(F.col("action"))) / n / years).alias("trades_per_sym_yr"), (1 - F.avg(F.col("in_position").cast("double"))).alias("cash_share"))
        one = use.crossJoin(performance(equal_weight(held), years)).crossJoin(flat).withColumn("rule", F.lit(rule))  # single rows
        out = one if out is None else out.unionByName(one)
    return out


def best_rule(compared: DataFrame) -> str:
    """The re-entry rule with the least drawdown, the first of RULES on ties."""
    depth = {r.rule: r.max_drawdown for r in compared.select("rule", "max_drawdown").collect()}  # one row per rule
    known = [r for r in RULES if depth.get(r) is not None]
    return max(known, key=lambda r: depth[r]) if known else RULES[-1]


def stress(scored: DataFrame, returns: DataFrame, windows: dict[str, tuple[str, str]], rule: str, c: SignalConfig = SignalConfig(), min_bars: int = 40) -> DataFrame:
    """One row per window: returns and drawdowns with signals and without, and trades per symbol and year.

    ``scored`` has intensities of a model fitted before all windows. Each
    window starts its signals anew, on the symbols with ``min_bars`` days in it.
    """
    n, out = returns.select("symbol").distinct().count(), None
    for label, (a, b) in windows.items():
        inside = F.col("dt").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
        span = F.datediff(F.max("dt"), F.min("dt")) / 365.25
        years = max(returns.filter(inside).agg(span.alias("y")).first().y or 0.0, 1 / 12)
        part = long_enough(scored.filter(inside), min_bars)
        mine = returns.filter(inside).join(part.select("symbol").distinct(), "symbol", "left_semi")
        held = mine.join(generate(part, rule, c), ["symbol", "dt"], "left").withColumn("in_position", F.coalesce("in_position", F.lit(True)))
        curve = lambda d: performance(equal_weight(d), 1.0).select((F.col("cagr") * 100).alias("ret"), (F.col("max_drawdown") * 100).alias("dd"))
        with_, flat = curve(held).toDF("strategy_return", "strategy_drawdown"), curve(mine.withColumn("in_position", F.lit(True))).toDF("bh_return", "bh_drawdown")
        use = held.agg((F.count_if(is_sell(F.col("action"))) / n / years).alias("trades_per_sym_yr"))
        one = with_.crossJoin(flat).crossJoin(use).withColumns({"window": F.lit(label), "rule": F.lit(rule), "drawdown_saved": F.col("strategy_drawdown") - F.col("bh_drawdown")})  # single rows
        out = one if out is None else out.unionByName(one)
    return out


def contribution(returns: DataFrame, signals: DataFrame) -> DataFrame:
    """symbol, edge_pp, exits, share of the total absolute edge."""
    d = returns.join(signals.select("symbol", "dt", "in_position", "action"), ["symbol", "dt"], "left")
    ret = F.coalesce("ret", F.lit(0.0))
    kept = F.when(F.coalesce("in_position", F.lit(True)), ret).otherwise(0.0)
    by = d.groupBy("symbol").agg(
        ((F.exp(F.sum(F.ln(kept + 1))) - F.exp(F.sum(F.ln(ret + 1)))) * 100).alias("edge_pp"), F.count_if(is_sell(F.col("action"))).alias("exits")
    )
    total = F.sum(F.abs("edge_pp")).over(Window.partitionBy())  # one row per symbol
    return by.select("symbol", "edge_pp", "exits", F.try_divide(F.abs("edge_pp"), total).alias("share"))
