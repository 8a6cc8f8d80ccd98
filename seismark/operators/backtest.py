"""Backtest of equal sleeves with costs and capital-gains tax."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seismark.config import CostConfig, TaxConfig
from seismark.functions.scalars import financial_year

CASH_BUFFER = 0.005
FOLD = "symbol string, dt date, side string, qty long, price double, total_cost double, cash double, held long, gain double, bought date"


@dataclass(frozen=True)
class _Rates:
    c: CostConfig

    def fill(self, price: float, side: str, vol_ratio: float) -> float:
        extra = max((vol_ratio if math.isfinite(vol_ratio) else 1.0) - 1.0, 0.0)
        slip = min(self.c.base_slippage * (1.0 + self.c.vol_beta * extra), self.c.max_slippage)
        return price * (1.0 + slip if side == "buy" else 1.0 - slip)

    def cost(self, side: str, price: float, qty: int, on: dt.date) -> float:
        c, notional = self.c, price * qty
        late = on >= dt.date.fromisoformat(c.exchange_change)
        taxed = notional * (c.brokerage + (c.exchange_after if late else c.exchange_before) + c.sebi)
        side_cost = notional * c.stamp_duty if side == "buy" else c.dp_charge
        return taxed * (1 + c.gst) + notional * c.stt + side_cost


def sleeves(days: DataFrame, capital_each: float, rates: CostConfig = CostConfig()) -> DataFrame:
    """Every priced session of every sleeve, after its trade.

    ``days``: symbol, dt, close, in_position, vol_ratio. Cash never crosses
    sleeves, so each symbol folds on its own.
    """
    r = _Rates(rates)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cash, held, paid, bought = capital_each, 0, 0.0, None
        rows = []
        for s, day, price, want, ratio in pdf.sort_values("dt")[["symbol", "dt", "close", "in_position", "vol_ratio"]].itertuples(index=False):
            side = qty = fill = cost = gain = since = None
            if held and not want:
                fill = r.fill(price, "sell", ratio)
                cost = r.cost("sell", fill, held, day)
                side, qty, gain, since = "sell", held, (fill - paid) * held, bought
                cash, held, bought = cash + fill * held - cost, 0, None
            elif not held and want and cash > 0:
                fill = r.fill(price, "buy", ratio)
                n = int(cash * (1.0 - CASH_BUFFER) // fill)
                charge = r.cost("buy", fill, n, day)
                if n > 0 and fill * n + charge <= cash:
                    side, qty, cost = "buy", n, charge
                    cash, held, paid, bought = cash - fill * n - charge, n, fill, day
                else:
                    fill = None
            rows.append((s, day, side, qty, fill, cost, cash, held, gain, since if side == "sell" else bought))
        return pd.DataFrame(rows, columns=["symbol", "dt", "side", "qty", "price", "total_cost", "cash", "held", "gain", "bought"]).astype({"qty": "Int64"})

    priced = days.filter("close > 0").select("symbol", "dt", "close", "in_position", F.coalesce("vol_ratio", F.lit(1.0)).alias("vol_ratio"))
    return priced.groupBy("symbol").applyInPandas(run, FOLD)


def trades(fold: DataFrame) -> DataFrame:
    return fold.filter("side IS NOT NULL").select("symbol", "dt", "side", "qty", "price", "total_cost")


def realised(fold: DataFrame) -> DataFrame:
    """symbol, sold_on, qty, gain (before costs), holding_days."""
    return fold.filter("side = 'sell'").select("symbol", F.col("dt").alias("sold_on"), "qty", "gain", F.datediff("dt", "bought").alias("holding_days"))


def open_lots(fold: DataFrame, closes: DataFrame) -> DataFrame:
    """What is still held at the last session, sold at its raw price if the symbol has one that day."""
    final = closes.agg(F.max("dt").alias("final"))
    bought = fold.filter("side = 'buy'").groupBy("symbol").agg(F.max_by(F.struct("dt", "qty", "price"), "dt").alias("b"))
    state = fold.groupBy("symbol").agg(F.max_by("held", "dt").alias("held"), F.max("dt").alias("last_dt"))
    last = closes.join(F.broadcast(final), F.col("dt") == F.col("final")).select("symbol", "final", F.col("close").alias("px"))
    left = state.filter("held > 0").join(bought, "symbol").join(last, "symbol").filter("px IS NOT NULL")
    return left.select("symbol", F.col("final").alias("sold_on"), F.col("b.qty").alias("qty"), ((F.col("px") - F.col("b.price")) * F.col("b.qty")).alias("gain"), F.datediff("final", "b.dt").alias("holding_days"))


def equity(fold: DataFrame, panel: DataFrame, capital_each: float) -> DataFrame:
    """dt, equity on every calendar session: cash and holdings at the last known price. ``panel``: symbol, dt, last_close."""
    w = Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    d = panel.select("symbol", "dt", "last_close").join(fold.select("symbol", "dt", "cash", "held"), ["symbol", "dt"], "left")
    cash = F.coalesce(F.last("cash", ignorenulls=True).over(w), F.lit(capital_each))
    held = F.coalesce(F.last("held", ignorenulls=True).over(w), F.lit(0))
    return d.select("dt", (cash + held * F.coalesce("last_close", F.lit(0.0))).alias("v")).groupBy("dt").agg(F.sum("v").alias("equity"))


def capital_gains(sales: DataFrame, t: TaxConfig = TaxConfig()) -> DataFrame:
    """fy, stcg_gain, ltcg_gain, tax. Rates are those of the year's last sale; losses net within their class and year."""
    long_ = F.col("holding_days") >= t.long_term_days
    by = sales.groupBy(financial_year(F.col("sold_on")).alias("fy")).agg(
        F.max("sold_on").alias("as_of"), F.sum(F.when(~long_, F.col("gain")).otherwise(0.0)).alias("stcg_gain"), F.sum(F.when(long_, F.col("gain")).otherwise(0.0)).alias("ltcg_gain")
    )
    late = F.col("as_of") >= F.lit(t.change).cast("date")
    pick = lambda new, old: F.when(late, new).otherwise(old)
    short = F.greatest("stcg_gain", F.lit(0.0)) * pick(t.stcg_after, t.stcg_before)
    taxed = F.greatest(F.col("ltcg_gain") - pick(t.exemption_after, t.exemption_before), F.lit(0.0)) * pick(t.ltcg_after, t.ltcg_before)
    return by.select("fy", "stcg_gain", "ltcg_gain", (short + taxed).alias("tax"))


def after_tax(curve: DataFrame, bills: DataFrame) -> DataFrame:
    """dt, equity less tax: each year's bill from 31 March on, later bills on the last session."""
    last = curve.agg(F.max("dt").alias("last_dt"))
    due = bills.crossJoin(last).select("tax", F.least(F.make_date(F.col("fy") + 1, F.lit(3), F.lit(31)), F.col("last_dt")).alias("due"))
    paid = due.groupBy("due").agg(F.sum("tax").alias("tax"))
    both = curve.select("dt", "equity", F.lit(0.0).alias("tax")).unionByName(paid.select(F.col("due").alias("dt"), F.lit(None).cast("double").alias("equity"), "tax"))
    w = Window.orderBy("dt").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # one row per date
    return both.withColumn("paid", F.sum("tax").over(w)).filter("equity IS NOT NULL").select("dt", (F.col("equity") - F.col("paid")).alias("equity"))
