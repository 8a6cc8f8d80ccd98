"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from seismark.config import Bands, CostConfig

EPS = 1e-12


def safe_log(x: Column) -> Column:
    """Natural log; NULL for zero, negative or missing."""
    return F.when(x > 0, F.ln(x))


def simple_percent(log_return: Column) -> Column:
    """A log return as a simple return in per cent, for reports."""
    return F.expm1(log_return) * 100


def guarded(num: Column, den: Column) -> Column:
    """num / den where den is clearly above zero, else NULL."""
    return num / F.when(den > EPS, den)


def keyed_digest(*keys: object) -> Column:
    """A digest of a row's symbol and date under ``keys``, which any engine gets alike."""
    return F.md5(F.concat_ws("|", "symbol", F.col("dt").cast("string"), *[F.lit(str(k)) for k in keys]).cast("binary"))


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("dt")


def trailing(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def rolling(agg: Column, counted: Column, n: int, least: int | None = None) -> Column:
    """``agg`` over the last n bars, NULL unless ``least`` (default n) values of ``counted`` are there."""
    w = trailing(n)
    return F.when(F.count(counted).over(w) >= (least or n), agg.over(w))


def financial_year(dt: Column) -> Column:
    return F.year(F.add_months(dt, -3))


def band(intensity: Column, bands: Bands = Bands()) -> Column:
    return (
        F.when(intensity >= bands.high, "High").when(intensity >= bands.moderate, "Moderate").when(intensity >= bands.low, "Low").otherwise("None")
    )


def is_sell(action: Column) -> Column:
    return action.isin("EXIT", "EXIT_WATCH")


def signal_strength(intensity: Column, slope_z: Column) -> Column:
    return F.coalesce(intensity, F.lit(0.0)) * F.coalesce(F.abs(slope_z), F.lit(0.0))


def slippage(price: Column, side: Column, vol_ratio: Column, rates: CostConfig = CostConfig()) -> Column:
    """Fill price: buys pay more, sells get less, widening with volatility up to a cap."""
    extra = F.greatest(F.coalesce(vol_ratio, F.lit(1.0)) - 1.0, F.lit(0.0))
    slip = F.least(F.lit(rates.base_slippage) * (1.0 + rates.vol_beta * extra), F.lit(rates.max_slippage))
    sign = F.when(side == "buy", 1.0).when(side == "sell", -1.0).otherwise(F.raise_error(F.concat(F.lit("bad side "), side)).cast("double"))
    return price * (1.0 + sign * slip)


def leg_cost(side: Column, price: Column, qty: Column, on: Column, rates: CostConfig = CostConfig()) -> Column:
    """All charges of one trade leg, as a struct."""
    notional = price * qty
    exchange = notional * F.when(on >= F.lit(rates.exchange_change).cast("date"), rates.exchange_after).otherwise(rates.exchange_before)
    brokerage, sebi = notional * rates.brokerage, notional * rates.sebi
    gst = (brokerage + exchange + sebi) * rates.gst
    stamp = F.when(side == "buy", notional * rates.stamp_duty).otherwise(0.0)
    stt = notional * rates.stt
    dp = F.when(side == "sell", rates.dp_charge).otherwise(0.0)
    total = brokerage + exchange + sebi + gst + stamp + stt + dp
    return F.struct(
        notional.alias("notional"), brokerage.alias("brokerage"), exchange.alias("exchange"), sebi.alias("sebi"), gst.alias("gst"),
        stamp.alias("stamp_duty"), stt.alias("stt"), dp.alias("dp_charge"), total.alias("total_cost"),
    )
