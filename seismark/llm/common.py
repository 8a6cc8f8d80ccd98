"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words: space and the five ASCII controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark drops an action's shuffle files when it ends; what the action made is in the checkpoint by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Unset, a local run or a test gets a temporary folder; a cluster raises."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="seismark-")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; the shuffle files behind it go at once."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a new plan, as the setting is read when a plan is made
    finally:
        spark.conf.set(CLEANUP, before)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a checkpoint or what is as cheap to count, marked for broadcast up to ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        return name if name.lower() not in taken else free(f"_{name}")

    return [free(n) for n in names]


#: Rows of an Arrow batch between Spark and Python, and rows that Python works on at once: texts may be long.
BATCH_ROWS, PART_ROWS = 1_000, 250


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold few rows, as some texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, so that what is made of one is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_words(text: Column) -> Column:
    """All words of a text, in order; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, buckets: int = 64) -> DataFrame:
    """Add ``name``: a gapless 0-based rank of each row within ``keys``.

    A group may hold any share of the rows: rows are first ranked inside
    hashed buckets of their group, then shifted by the sizes of the buckets
    before. ``order`` must identify a row up to exact repeats.
    """
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    starts = starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_kb"), "_start")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = spread.withColumn("_rank", F.row_number().over(inside) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket") == F.col("_kb")]
    out = local.join(starts, on, "inner").withColumn(name, (F.col("_start") + F.col("_rank")).cast("long"))
    return out.drop("_bucket", "_kb", "_start", "_rank", *[f"_k_{k}" for k in keys])
