"""Sources and sinks of daily bars: symbol, dt, open, high, low, close, volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType(
    [T.StructField("date", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")]
    + [T.StructField("volume", T.LongType()), T.StructField("adjusted_close", T.DoubleType())]
)


def read_csv(spark: SparkSession, folder: str, date_format: str = "dd-MM-yyyy", schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """One CSV file per symbol, named after it. A date in another format raises.

    seq follows the order within a file, also where it is read in several
    splits: the start of the split, then the row's number in its task. A task
    reads the splits it is given one after another, so that number grows
    within each of them.
    """
    raw = spark.read.schema(schema).option("header", True).csv(folder)
    symbol = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    seq = F.struct(F.col("_metadata.file_block_start").alias("block"), row.alias("row"))
    named = raw.withColumn("symbol", symbol).withColumn("seq", seq)
    named = named.withColumnRenamed("adjusted_close", "adj_close") if "adjusted_close" in named.columns else named
    return named.withColumn("dt", F.to_date("date", date_format)).drop("date")


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet; with ``by``, one folder per value, so later reads prune."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def state(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of change of the files under ``path``, asked of the store that holds them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in store.listStatus(hadoop)))


def read_csv_if_there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with a header, or an empty frame of that schema if the path is absent."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).csv(path, header=True) if there else spark.createDataFrame([], schema)


def read_if_there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty frame of that schema if the path is absent."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def from_lineitem(spark: SparkSession, sf_dir: str, k: float = 0.008) -> DataFrame:
    """Daily bars made from order lines: a brand is a symbol, a ship date a session.

    Prices follow order-independent integer sums, so any engine gets the same.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("symbol"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    daily = (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .groupBy("symbol", F.to_date("l_shipdate").alias("dt"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("dc"),
            F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tc"), F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        )
    )
    # prices are whole ten-thousandths until the end, so that rounding has no ties to settle
    w = Window.partitionBy("symbol").orderBy("dt")
    step = F.greatest(F.lit(-8), F.least(F.lit(8), F.col("dc") - F.col("n") * 5))
    cum = F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))
    priced = daily.withColumn("c", F.round(F.exp(cum * F.lit(k)) * 1_000_000).cast("long")).withColumn("prev", F.coalesce(F.lag("c").over(w), F.col("c")))
    priced = priced.withColumn("tilt", F.greatest(F.lit(-100), F.least(F.lit(100), F.col("tc") - F.col("n") * 4)))
    flat = F.expr("(dc + tc) % 29 = 0")
    priced = priced.withColumn("o", F.when(flat, F.col("c")).otherwise(F.expr("(prev * (500 + tilt) + 250) div 500")))
    top, low = F.expr("(greatest(o, c) * (1000 + (n + tc) % 5) + 500) div 1000"), F.expr("(least(o, c) * (1000 - tc % 5) + 500) div 1000")
    price = lambda x: x / F.lit(1e4)
    return priced.select(
        "symbol", "dt", price(F.col("o")).alias("open"), price(F.when(flat, F.col("c")).otherwise(top)).alias("high"),
        price(F.when(flat, F.col("c")).otherwise(low)).alias("low"), price(F.col("c")).alias("close"),
        F.when((F.col("dc") * 7 + F.col("tc")) % 31 == 0, F.lit(0).cast("long")).otherwise(F.col("qty")).alias("volume"),
    )


def with_defects(bars: DataFrame) -> DataFrame:
    """Raw bars as a vendor might send them: repeated dates, a bad last repeat, a long gap and an unadjusted split."""
    body = bars.filter(~((F.col("symbol") == "Brand#11") & F.col("dt").between("1996-03-01", "1996-03-25")))
    split = (F.col("symbol") == "Brand#22") & (F.col("dt") < "1996-06-03")
    for c in ("open", "high", "low", "close"):
        body = body.withColumn(c, F.when(split, F.round(F.col(c) * 3.0, 4)).otherwise(F.col(c)))
    first = body.withColumn("seq", F.lit(1).cast("long"))
    twice = body.filter("volume % 17 = 0").withColumn("seq", F.lit(0).cast("long")).withColumn("close", F.expr("(cast(round(close * 10000) as bigint) + 1) div 2") / F.lit(1e4))
    bad = body.filter("volume % 41 = 3").withColumn("seq", F.lit(2).cast("long")).withColumn("close", F.lit(0.0))
    return first.unionByName(twice).unionByName(bad)
