"""Settings of the engine, as plain frozen values passed to operators.

The defaults of cleaning, gate, features, bands, signals, labels, costs, tax,
model and retraining are fixed values: results match only with these.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class WindowConfig:
    """Training must end before the backtest begins."""

    train_start: str = "2016-01-01"
    train_end: str = "2020-12-31"
    backtest_start: str = "2021-01-01"
    backtest_end: str = "2026-06-05"
    stress_train_end: str = "2019-12-31"

    def __post_init__(self) -> None:
        if dt.date.fromisoformat(self.train_end) >= dt.date.fromisoformat(self.backtest_start):
            raise ValueError("the training window must end before the backtest begins")

    @property
    def backtest_years(self) -> float:
        return (dt.date.fromisoformat(self.backtest_end) - dt.date.fromisoformat(self.backtest_start)).days / 365.25


@dataclass(frozen=True)
class CleaningConfig:
    date_format: str = "dd-MM-yyyy"
    max_gap_days: int = 10
    max_abs_log_return: float = 0.50
    hard_end: str = "2026-06-05"
    min_bars: int = 300


@dataclass(frozen=True)
class GateConfig:
    min_symbols: int = 80
    min_sessions: int = 1000
    train_start: str = "2016-01-01"
    max_end_span_days: int = 7
    max_flat_share: float = 0.10


@dataclass(frozen=True)
class FeatureConfig:
    slope_window: int = 5
    accel_window: int = 7
    short_vol: int = 5
    med_window: int = 20
    vol_window: int = 60
    vol_lag: int = 20
    min_obs: int = 30
    gap_threshold: float = 0.01
    slope_deadband: float = 0.10
    accel_deadband: float = 0.05


@dataclass(frozen=True)
class Bands:
    high: float = 0.99
    moderate: float = 0.95
    low: float = 0.90


@dataclass(frozen=True)
class SignalConfig:
    exit_intensity: float = 0.99
    moderate_intensity: float = 0.95
    reentry_intensity: float = 0.95
    persistence: int = 1
    watch_days: int = 5
    min_hold: int = 3
    cooldown: int = 3
    max_cash_days: int = 20


@dataclass(frozen=True)
class LabelConfig:
    horizon: int = 5
    crash: float = -0.10
    rally: float = 0.10
    index_crash: float = -0.05
    min_gap: int = 10
    max_lookback: int = 15


@dataclass(frozen=True)
class CostConfig:
    """Fractions of turnover; fixed values of the market modelled."""

    brokerage: float = 0.0
    sebi: float = 0.000001
    stamp_duty: float = 0.00015
    gst: float = 0.18
    stt: float = 0.001
    dp_charge: float = 15.34
    base_slippage: float = 0.0005
    vol_beta: float = 1.0
    max_slippage: float = 0.01
    exchange_before: float = 0.0000325
    exchange_after: float = 0.0000297
    exchange_change: str = "2024-10-01"


@dataclass(frozen=True)
class TaxConfig:
    """Capital-gains rates; fixed values of the market modelled."""

    stcg_before: float = 0.15
    stcg_after: float = 0.20
    ltcg_before: float = 0.10
    ltcg_after: float = 0.125
    exemption_before: float = 100_000.0
    exemption_after: float = 125_000.0
    change: str = "2024-07-23"
    long_term_days: int = 365


@dataclass(frozen=True)
class ModelConfig:
    trees: int = 300
    samples: int = 256
    seed: int = 0
    max_scores: int = 50_000


@dataclass(frozen=True)
class RetrainConfig:
    rolling_years: int = 3
    purge_quantile: float = 0.90
    ewma_decay: float = 0.994
    min_train_rows: int = 2000
    schemes: tuple[str, ...] = ("rolling", "incremental", "ewma", "vol_purged")


#: Model inputs, in order.
FEATURE_COLUMNS = (
    "vol_ratio", "vol_of_vol", "semidev_asym", "volume_z", "range_expansion",
    "gap_freq", "illiquidity", "dd_from_high", "slope_z", "accel_z",
)
