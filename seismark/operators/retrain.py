"""Walk-forward retraining: schedules, training slices, schemes."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seismark.config import FEATURE_COLUMNS, ModelConfig, RetrainConfig
from seismark.functions.scalars import is_sell, keyed_digest
from seismark.operators import drawdown, forest


def refit_dates(calendar: DataFrame, start: str, end: str) -> DataFrame:
    """as_of, block_end: the first session of each month, and the next one (the last block ends after ``end``)."""
    firsts = calendar.filter(F.col("dt").between(start, end)).groupBy(F.date_trunc("MONTH", "dt")).agg(F.min("dt").alias("as_of"))
    after = F.lead("as_of").over(Window.orderBy("as_of"))  # one row per month
    return firsts.select("as_of", F.coalesce(after, F.date_add(F.lit(end).cast("date"), 1)).alias("block_end"))


def ewma_sample(rows: DataFrame, as_of: str, n: int, c: RetrainConfig = RetrainConfig(), seed: int = 0) -> DataFrame:
    """n rows without replacement, weighted by decay ** age: the largest Gumbel keys, drawn by a keyed hash."""
    u = (F.conv(F.substring(keyed_digest(as_of, seed), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    key = F.datediff(F.lit(as_of).cast("date"), "dt") * F.ln(F.lit(c.ewma_decay)) - F.ln(-F.ln(u))
    return rows.withColumn("_key", key).orderBy(F.desc("_key"), "symbol", "dt").limit(n).drop("_key")


def _ewma(features: DataFrame, as_of: str, c: RetrainConfig, seed: int) -> DataFrame:
    seen = features.filter(F.col("dt") < F.lit(as_of).cast("date"))
    stats = seen.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("s")).first()
    return ewma_sample(seen, as_of, min(stats.n, max(int(4 * stats.s / (1 - c.ewma_decay)), 5000)), c, seed)


def training_slices(features: DataFrame, dates: list[str], scheme: str, market: DataFrame | None = None, c: RetrainConfig = RetrainConfig(), seed: int = 0) -> DataFrame:
    """``features`` with as_of: for each date the rows a scheme may learn from, all before it.

    A row is repeated for the dates it serves, in one narrow step; only ewma
    draws date by date.
    """
    if scheme not in ("incremental", "rolling", "vol_purged", "ewma"):
        raise ValueError(f"unknown scheme {scheme!r}")
    if not dates:
        return features.limit(0).withColumn("as_of", F.lit(None).cast("date"))
    if scheme == "ewma":
        parts = [_ewma(features, d, c, seed).withColumn("as_of", F.lit(d).cast("date")) for d in dates]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    after = lambda d: (F.col("dt") < d) & (F.lit(scheme == "incremental") | (F.col("dt") >= F.add_months(d, -12 * c.rolling_years)))
    served = lambda df: df.withColumn("as_of", F.explode(F.filter(F.array(*[F.lit(d).cast("date") for d in dates]), after)))
    rows = served(features)
    if scheme != "vol_purged" or market is None:
        return rows
    # one row per session and date
    days = served(market.join(features.select("dt").distinct(), "dt", "left_semi"))
    bars = days.groupBy("as_of").agg(F.percentile("dispersion", c.purge_quantile).alias("_q"))
    purged = days.join(bars, "as_of").filter(F.col("dispersion") > F.col("_q")).select("as_of", "dt")
    return rows.join(purged, ["as_of", "dt"], "left_anti")


def training_slice(features: DataFrame, as_of: str, scheme: str, market: DataFrame | None = None, c: RetrainConfig = RetrainConfig(), seed: int = 0) -> DataFrame:
    """The rows a scheme may learn from on ``as_of``: all are before it."""
    return training_slices(features, [as_of], scheme, market, c, seed).drop("as_of")


def _numbered_slices(features: DataFrame, dates: list[str], scheme: str, market: DataFrame | None, c: RetrainConfig, seed: int) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Numbered complete rows, and by refit date the spans of numbers that a scheme may learn from. Dates with too few rows are left out.

    Slices are sets of sessions, so their bounds, and the sessions purged, are
    worked out on one row per session.
    """
    if scheme == "ewma":
        parts = training_slices(features, dates, scheme, market, c, seed).withColumn("key", F.col("as_of").cast("string"))
        seen = {r.key: r.n for r in parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
        whole = parts.select("key", "symbol", "dt", *[F.col(f).cast("double").alias(f) for f in FEATURE_COLUMNS]).dropna().persist()
        counts = {r.key: r.n for r in whole.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
        spans, at = {}, 0
        for key in sorted(counts):
            spans[key] = np.array([[at, counts[key]]])
            at += counts[key]
        start = F.element_at(F.create_map(*[F.lit(x) for k, v in spans.items() for x in (k, int(v[0, 0]))]), F.col("key")) if spans else F.lit(0)
        rank = F.row_number().over(Window.partitionBy("key").orderBy("dt", "symbol")) - 1  # a sample of bounded size
        return whole.withColumn("g", start + rank), {k: v for k, v in spans.items() if seen[k] >= c.min_train_rows}
    rows = forest.numbered(features)
    per_day = {str(r.dt): r.n for r in features.groupBy("dt").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per session
    sessions = np.array(sorted(per_day), "datetime64[D]")
    sizes = np.array([per_day[str(d)] for d in sessions])
    spread = {str(r.dt): r.x for r in market.select("dt", F.col("dispersion").alias("x")).collect()} if market is not None else {}
    values = np.array([spread[str(d)] if spread.get(str(d)) is not None else np.nan for d in sessions])
    spans = {}
    for as_of in dates:
        day = dt.date.fromisoformat(as_of)
        first = dt.date.min if scheme == "incremental" else back(day, c.rolling_years)
        inside = (sessions < np.datetime64(as_of)) & (sessions >= np.datetime64(first))
        # vol_purged withholds the sessions above the quantile of its own window
        bar = np.nanquantile(values[inside], c.purge_quantile) if scheme == "vol_purged" and np.isfinite(values[inside]).any() else np.inf
        open_ = inside & ~(values > bar)
        mask = np.isin(rows.days, sessions[open_])
        if sizes[open_].sum() >= c.min_train_rows and rows.counts[mask].sum():
            spans[as_of] = rows.spans(mask)
    return rows.frame, spans


def back(day: dt.date, years: int) -> dt.date:
    """The same day ``years`` before; 28 February for a 29th that is not there."""
    try:
        return day.replace(year=day.year - years)
    except ValueError:
        return day.replace(year=day.year - years, day=28)


def walk_forward(features: DataFrame, schedule: DataFrame, scheme: str, market: DataFrame | None = None, c: RetrainConfig = RetrainConfig(), model: ModelConfig = ModelConfig()) -> DataFrame:
    """symbol, dt, as_of, score, intensity: each block scored by the forest of its own refit date.

    All forests are grown in one job and all blocks scored in another.
    Randomness is keyed on date, tree and the rows' numbers, so blocks do not
    depend on one another's order. Blocks with too few training rows are left out.
    """
    if scheme not in c.schemes:
        raise ValueError(f"unknown scheme {scheme!r}")
    blocks = {str(r.as_of): str(r.block_end) for r in schedule.orderBy("as_of").collect()}  # one row per month
    frame, spans = _numbered_slices(features, list(blocks), scheme, market, c, model.seed)
    if not spans:
        return features.sparkSession.createDataFrame([], "symbol string, dt date, as_of date, score double, intensity double")
    forests = forest.fit_each(frame, spans, model)
    bounds = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(k).cast("date").alias("a"), F.lit(blocks[k]).cast("date").alias("z")) for k in spans])
    mine = F.filter(bounds, lambda s: (F.col("dt") >= s["a"]) & (F.col("dt") < s["z"]))
    block = features.select("symbol", "dt", *FEATURE_COLUMNS, F.explode(mine).alias("_s")).withColumn("_key", F.col("_s.key")).drop("_s")
    done = forest.score_each(block, forests, "_key")
    return done.select("symbol", "dt", F.col("_key").cast("date").alias("as_of"), "score", "intensity")


def per_symbol(signals: DataFrame, closes: DataFrame, scheme: str, min_bars: int = 250) -> DataFrame:
    """scheme, symbol, max_drawdown, bh_max_drawdown, total_return, exits of every symbol with enough bars."""
    table = drawdown.by_symbol(closes, signals, min_bars)
    return table.select(
        F.lit(scheme).alias("scheme"), "symbol", F.col("strategy_max_drawdown").alias("max_drawdown"), F.col("bh_max_drawdown"), F.col("strategy_return").alias("total_return"), "exits"
    )


def coverage(signals: DataFrame, symbols: int, years: float, scheme: str) -> DataFrame:
    """One row: how many of ``symbols`` the scheme sold at all, how often, and that per symbol and year."""
    sold = is_sell(F.col("action"))
    exits = F.count_if(sold)
    return signals.agg(F.count_distinct(F.when(sold, F.col("symbol"))).alias("traded"), exits.alias("exits"), (exits / symbols / years).alias("per_symbol_year")).select(
        F.lit(scheme).alias("scheme"), "traded", F.lit(symbols).cast("long").alias("symbols"), "exits", "per_symbol_year"
    )


def scheme_results(rows: DataFrame) -> DataFrame:
    """``rows`` (scheme, cagr, max_drawdown, bh_max_drawdown, trades_per_symbol_year) with drawdown_saved, efficiency and both ranks."""
    saved = (F.col("max_drawdown") - F.col("bh_max_drawdown")) * 100
    turns = F.col("trades_per_symbol_year")
    out = rows.withColumn("drawdown_saved", saved).withColumn("efficiency", F.when(turns > 0, saved / F.nullif(turns, F.lit(0.0))).otherwise(0.0))
    place = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "scheme"))  # noqa: E731  one row per scheme
    return out.withColumns({"place": place("efficiency"), "saved_place": place("drawdown_saved")})
