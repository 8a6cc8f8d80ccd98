"""Inputs of the registered queries, made lazily from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import ClassVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seismark.config import CleaningConfig, LabelConfig
from seismark.functions.scalars import band
from seismark.operators import alignment, backtest, cleaning, features, intensity, labels, market, regime, signals
from seismark.sources import bars as source

CLEANING = CleaningConfig(min_bars=200)
TRAIN_END = "1998-12-31"
CAPITAL = 1_000_000.0
#: Market windows on a sparse calendar.
CORR_WINDOW, MA_WINDOW, MIN_SYMBOLS = 5, 5, 5


def _shared(make: Callable[[Context], DataFrame]) -> cached_property:
    """A table that many queries read: made once and kept on the executors, with its lineage, so a lost part is made again."""

    def build(self: Context) -> DataFrame:
        return make(self).persist(StorageLevel.MEMORY_AND_DISK)

    build.__doc__ = make.__doc__
    return cached_property(build)


class Context:
    """The tables between the inputs and the queries. ``of`` gives one context for one state of the input files."""

    _known: ClassVar[dict[tuple, Context]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self.walks: dict[str, DataFrame] = {}  # scored days by retraining scheme

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Context:
        """The context of this session and these files; files that have changed since give a new one, and the last one's tables go."""
        key = (spark.sparkContext.applicationId, id(spark), sf_dir, *(source.state(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part")))
        if key not in cls._known:
            for old in cls._known.values():
                old.release()
            cls._known = {key: cls(spark, sf_dir)}
        return cls._known[key]

    def release(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            for table in (*vars(self).values(), *self.walks.values()):
                if isinstance(table, DataFrame):
                    table.unpersist()

    @_shared
    def bars(self) -> DataFrame:
        return source.from_lineitem(self.spark, self.dir)

    @cached_property
    def flagged(self) -> DataFrame:
        return cleaning.flagged(self.bars)

    @cached_property
    def raw(self) -> DataFrame:
        return source.with_defects(self.bars)

    @_shared
    def days(self) -> DataFrame:
        return alignment.calendar(self.bars)

    @_shared
    def features(self) -> DataFrame:
        return features.precursors(self.flagged)

    @cached_property
    def proxy(self) -> DataFrame:
        """Features with a plain score in place of the forest's, so that SQL can follow."""
        return self.features.withColumn("score", F.abs("slope_z") + F.abs(F.col("vol_ratio") - 1))

    @_shared
    def scored(self) -> DataFrame:
        train = intensity.train_window(self.proxy, "1995-01-01", TRAIN_END)
        return intensity.ecdf(self.proxy, train)

    @_shared
    def frame(self) -> DataFrame:
        """Signal inputs: scored days with an absolute-mode regime."""
        return self.scored.join(regime.detect(self.bars, "absolute", vol_warmup=1, lookback=2).select("symbol", "dt", "regime"), ["symbol", "dt"])

    @_shared
    def signals(self) -> DataFrame:
        return signals.generate(self.frame, "not_declining")

    def market_with(self, corr_window: int, ma_window: int, min_symbols: int) -> DataFrame:
        mask = alignment.listing_mask(self.bars, self.days)
        panel = alignment.panel(self.bars, self.days, "close")
        return market.market_features(panel, features.slope_accel(self.bars), mask, corr_window, ma_window, min_symbols)

    @_shared
    def market(self) -> DataFrame:
        return self.market_with(CORR_WINDOW, MA_WINDOW, MIN_SYMBOLS)

    @_shared
    def label_days(self) -> DataFrame:
        return labels.label_days(self.bars)

    @_shared
    def crashes(self) -> DataFrame:
        return labels.onsets(self.label_days, "is_crash", LabelConfig().min_gap)

    @cached_property
    def alerts(self) -> DataFrame:
        return self.scored.filter(F.col("intensity") >= 0.95).select("symbol", "dt")

    @cached_property
    def returns(self) -> DataFrame:
        """Simple returns between a symbol's own bars."""
        return signals.simple_returns(self.bars)

    @cached_property
    def held_returns(self) -> DataFrame:
        return self.returns.join(self.signals.select("symbol", "dt", "in_position"), ["symbol", "dt"], "left")

    @cached_property
    def banded(self) -> DataFrame:
        return self.scored.withColumn("band", band(F.col("intensity")))

    @cached_property
    def sleeve_capital(self) -> float:
        return CAPITAL / self.bars.select("symbol").distinct().count()

    @_shared
    def fold(self) -> DataFrame:
        """Every session of every sleeve of the backtest."""
        days = self.bars.join(self.signals.select("symbol", "dt", "in_position"), ["symbol", "dt"], "left")
        days = days.join(self.features.select("symbol", "dt", "vol_ratio"), ["symbol", "dt"], "left")
        return backtest.sleeves(days.withColumn("in_position", F.coalesce("in_position", F.lit(True))), self.sleeve_capital)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, integers to long: what both engines agree on."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + F.lit(3e-10), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
