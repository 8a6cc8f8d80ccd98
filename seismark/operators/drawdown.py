"""Drawdown curves, spells and per-symbol tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seismark.functions.scalars import is_sell


def series(equity: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, dt, equity, dd: the share below the running peak."""
    w = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return equity.filter("equity IS NOT NULL").withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1)


def stats(equity: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Depth, first peak and trough, recovery, sessions under water and the longest spell.

    All windows share one partitioning and order, and so does the grouping.
    """
    k = list(keys)
    order, all_ = Window.partitionBy(*k).orderBy("dt"), Window.partitionBy(*k)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(order)
    d = series(equity, keys).withColumns({"n": n, "u": F.col("dd") < -1e-9})
    # the running peak with its first session, and how long the curve has been under water
    d = d.withColumns({
        "p": F.max(F.struct("equity", (-F.col("n")).alias("m"))).over(upto),
        "spell": F.when(F.col("u"), F.col("n") - F.coalesce(F.max(F.when(~F.col("u"), F.col("n"))).over(upto), F.lit(0))).otherwise(0),
    })
    d = d.withColumn("t", F.min(F.struct("dd", "n", "dt", "p")).over(all_))
    back = (F.col("n") >= F.col("t.n")) & (F.col("equity") >= F.col("t.p.equity"))
    return d.groupBy(*k).agg(
        F.min("t.dd").alias("max_drawdown"), F.min(F.when(F.col("n") == -F.col("t.p.m"), F.col("dt"))).alias("max_dd_start"), F.min("t.dt").alias("max_dd_trough"),
        F.min(F.when(back, F.col("dt"))).alias("max_dd_recovered"), F.min(F.when(back, F.col("n") - F.col("t.n"))).alias("time_to_recover"),
        F.count_if("u").alias("days_under_water"), F.coalesce(F.max("spell"), F.lit(0)).cast("long").alias("longest_underwater"),
    )


def by_symbol(bars: DataFrame, signals: DataFrame, min_bars: int = 250) -> DataFrame:
    """Strategy against buy and hold, per symbol with enough bars. Both curves go through the same windows."""
    order = Window.partitionBy("symbol").orderBy("dt")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    d = bars.select("symbol", "dt", "close", F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("_n")).filter(F.col("_n") >= min_bars)
    d = d.join(signals.select("symbol", "dt", "in_position", "action"), ["symbol", "dt"], "left")
    ret = F.coalesce(F.col("close") / F.lag("close").over(order) - 1, F.lit(0.0))
    d = d.withColumn("ret", ret).withColumn("held", F.coalesce("in_position", F.lit(True)))
    grown = lambda r: F.exp(F.sum(F.ln(r + 1)).over(upto))
    d = d.withColumns({"s": grown(F.when(F.col("held"), F.col("ret")).otherwise(0.0)), "b": grown(F.col("ret"))})
    curves = F.explode(F.array(F.struct(F.lit("s").alias("curve"), F.col("s").alias("equity")), F.struct(F.lit("b").alias("curve"), F.col("b").alias("equity"))))
    names = ("max_drawdown", "days_under_water", "longest_underwater", "time_to_recover")
    each = stats(d.select("symbol", "dt", curves.alias("_c")).select("symbol", "dt", "_c.curve", "_c.equity"), ("symbol", "curve"))
    of = lambda curve, name: F.max(F.when(F.col("curve") == curve, F.col(name)))
    found = each.groupBy("symbol").agg(*[of("s", x).alias(x) for x in names], *[of("b", x).alias(f"bh_{x}") for x in names])
    use = d.groupBy("symbol").agg(
        (F.max_by("s", "dt") - 1).alias("strategy_return"), (F.max_by("b", "dt") - 1).alias("bh_return"),
        F.count_if(is_sell(F.col("action"))).alias("exits"), ((1 - F.avg(F.col("held").cast("double"))) * 100).alias("pct_days_in_cash"),
    )
    both = use.join(found, "symbol")
    return both.withColumnRenamed("max_drawdown", "strategy_max_drawdown").withColumn("drawdown_saved_pp", (F.col("strategy_max_drawdown") - F.col("bh_max_drawdown")) * 100)


def summary(table: DataFrame) -> DataFrame:
    """How many symbols were helped, hurt and never traded, and the mean and median saved."""
    s = F.col("drawdown_saved_pp")
    return table.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s > 0.1).alias("helped"), F.count_if(s < -0.1).alias("hurt"), F.count_if(F.col("exits") == 0).alias("untouched"),
        F.avg(s).alias("mean_saved_pp"), F.percentile(s, 0.5).alias("median_saved_pp"), F.max(s).alias("best_saved_pp"), F.min(s).alias("worst_saved_pp"),
    )


def cash_spells(signals: DataFrame) -> DataFrame:
    """symbol, start_dt, end_dt, sessions of every stay in cash."""
    w = Window.partitionBy("symbol").orderBy("dt")
    out = ~F.col("in_position")
    start = out & ~F.coalesce(F.lag(out).over(w), F.lit(False))
    runs = signals.select("symbol", "dt", out.alias("out"), start.cast("int").alias("s")).withColumn("g", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.filter("out").groupBy("symbol", "g").agg(F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt"), F.count(F.lit(1)).alias("sessions")).drop("g")
