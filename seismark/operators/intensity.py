"""From anomaly scores to intensities: the share of training scores not above."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seismark.functions.scalars import band

POOL_MIN = 100


def train_window(scores: DataFrame, start: str, end: str) -> DataFrame:
    return scores.filter(F.col("dt").between(start, end))


def ecdf(scores: DataFrame, train: DataFrame, score: str = "score", max_scores: int = 50_000, seed: int = 0) -> DataFrame:
    """``scores`` with intensity. The training scores, at most ``max_scores``
    (chosen by a keyed hash), are one sorted array that every task searches."""
    some = train.filter(F.col(score).isNotNull()).orderBy(F.xxhash64("symbol", "dt", F.lit(seed)), "symbol", "dt").limit(max_scores)
    scale = some.agg(F.sort_array(F.collect_list(score)).alias("_scale")).withColumn("_k", F.lit(1))
    joined = scores.withColumn("_k", F.lit(1)).join(F.broadcast(scale), "_k")
    # upper bound by bisection: 17 halvings cover max_scores
    lo, hi = F.lit(0), F.size("_scale")
    bounds = F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(acc, _):
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = F.get(F.col("_scale"), mid) <= F.col(score)
        done = acc["lo"] >= acc["hi"]
        return F.struct(
            F.when(done | ~right, acc["lo"]).otherwise(mid + 1).alias("lo"), F.when(done | right, acc["hi"]).otherwise(mid).alias("hi")
        )

    steps = F.sequence(F.lit(1), F.lit(max(1, max_scores).bit_length() + 1))
    rank = F.aggregate(steps, bounds, halve, lambda acc: acc["lo"])
    value = F.when(F.col(score).isNotNull() & (F.size("_scale") > 0), rank / F.size("_scale"))
    return joined.withColumn("intensity", value).drop("_scale", "_k")


def ecdf_per_symbol(scores: DataFrame, train: DataFrame, score: str = "score", least: int = POOL_MIN) -> DataFrame:
    """intensity on the symbol's own scale where it has ``least`` training rows, else on the pooled one."""
    pooled = ecdf(scores, train, score).withColumnRenamed("intensity", "_pooled")
    both = pooled.select("symbol", "dt", F.col(score).alias("_s"), "_pooled", F.lit(0).alias("_t")).unionByName(
        train.filter(F.col(score).isNotNull()).select("symbol", "dt", F.col(score).alias("_s"), F.lit(None).cast("double").alias("_pooled"), F.lit(1).alias("_t"))
    )
    upto = Window.partitionBy("symbol").orderBy("_s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum("_t").over(Window.partitionBy("symbol"))
    own = F.sum("_t").over(upto) / F.nullif(n, F.lit(0))
    value = F.when(F.col("_s").isNotNull(), F.when(n >= least, own).otherwise(F.col("_pooled")))
    return both.withColumn("intensity", value).filter("_t = 0").select("symbol", "dt", F.col("_s").alias(score), "intensity")


def band_counts(intensities: DataFrame) -> DataFrame:
    return intensities.groupBy(band(F.col("intensity")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"))


def alert_rates(intensities: DataFrame) -> DataFrame:
    """One row over ``intensities`` (symbol, dt, intensity, phase): high-band alerts, their rate per symbol and year, and the share in an accelerating decline."""
    high = band(F.col("intensity")) == "High"
    years = F.datediff(F.max("dt"), F.min("dt")) / 365.25
    falling = F.count_if(high & (F.col("phase") == "AcceleratingDecline"))
    return intensities.agg(
        F.count_if(high).alias("high_alerts"), F.try_divide(F.count_if(high), F.count_distinct("symbol") * years).alias("per_symbol_year"),
        falling.alias("declining"), F.try_divide(falling, F.greatest(F.count_if(high), F.lit(1))).alias("declining_share"),
    )
