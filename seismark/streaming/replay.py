"""The state machine as a stream: the same steps, with state kept per symbol.

Bars of a symbol must arrive in date order from batch to batch; within a batch
they are sorted. The batch form stays canonical, and tests compare the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seismark.config import SignalConfig
from seismark.operators.signals import START, step

OUT = "symbol string, dt date, in_position boolean, watching boolean, action string"
STATE = "holding boolean, since int, watch int"


def signals(inputs: DataFrame, c: SignalConfig = SignalConfig()) -> DataFrame:
    """``inputs``: a stream with the columns of ``operators.signals.prepared``."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(kept.get) if kept.exists else START
        pdf = pd.concat(list(batches)).sort_values("dt", kind="stable")
        rows = []
        for day, s, m, w, slope, back in pdf[["dt", "severe", "mild", "confirms", "slope", "reentry"]].itertuples(index=False):
            held, watching = state[0], state[2] > 0
            state, action = step(state, s, m, w, slope, back, c)
            rows.append((key[0], day, held, watching, action))
        kept.update(state)
        yield pd.DataFrame(rows, columns=["symbol", "dt", "in_position", "watching", "action"])

    return inputs.groupBy("symbol").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run(spark: SparkSession, folders: list[str], out: str, checkpoint: str) -> DataFrame:
    """Feed folders of prepared bars one after another through one stateful query; each call resumes from ``checkpoint``."""
    schema = spark.read.parquet(folders[0]).schema
    for folder in folders:
        # one source folder per start would change the query; bars move into one inbox instead
        spark.read.parquet(folder).coalesce(1).write.mode("append").parquet(f"{checkpoint}-inbox")
        query = (
            signals(spark.readStream.schema(schema).parquet(f"{checkpoint}-inbox"))
            .writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.parquet(out)
