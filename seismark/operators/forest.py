"""An isolation forest (Liu, Ting and Zhou 2008) on DataFrames.

Each tree grows from a keyed sample of all rows, one small group a tree, level
by level in numpy. Forests of many training sets (one for each refit date) are
grown in one job. A forest has trees * 4 * samples nodes at most, 13 bytes
each, so it is held by the driver and broadcast to the scoring tasks.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seismark.config import FEATURE_COLUMNS, ModelConfig

NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
_NAMES = ["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]
EULER = 0.5772156649015329
#: Rows scored at once, so that what a task works on stays in its cache.
CHUNK = 4096
#: Samples handed on at once.
JOBS = 64


def path_norm(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """feature, threshold and size of each node of one tree; leaves have feature -1.

    The children of node i are 2i + 1 and 2i + 2. All nodes of a level are split at once.
    """
    limit = math.ceil(math.log2(max(2, len(x))))
    total = 2 ** (limit + 1) - 1
    feature, threshold, size = np.full(total, -1, np.int8), np.zeros(total), np.zeros(total, np.int32)
    size[0], at, live = len(x), np.zeros(len(x), int), np.arange(len(x))
    for _ in range(limit):
        rows = live[np.argsort(at[live], kind="stable")]
        starts = np.flatnonzero(np.r_[True, np.diff(at[rows]) > 0])
        nodes, k = at[rows[starts]], np.arange(len(starts))
        low, high = np.minimum.reduceat(x[rows], starts), np.maximum.reduceat(x[rows], starts)
        open_ = high > low
        split = open_.any(1)
        pick = np.floor(rng.random(len(k)) * open_.sum(1))
        f = np.argmax(np.cumsum(open_, 1) > pick[:, None], 1)
        cut = low[k, f] + rng.random(len(k)) * (high[k, f] - low[k, f])
        feature[nodes[split]], threshold[nodes[split]] = f[split], cut[split]
        of = np.repeat(k, np.diff(np.r_[starts, len(rows)]))
        live, of = rows[split[of]], of[split[of]]
        if not len(live):
            break
        at[live] = 2 * at[live] + 1 + (x[live, f[of]] >= cut[of])
        size += np.bincount(at[live], minlength=total).astype(np.int32)
    return feature, threshold, size


@dataclass
class Forest:
    """``feature``, ``threshold`` and ``size``: by tree and node, as ``grow`` gives them. ``scale``: sorted scores of training rows, of which intensities are shares."""

    feature: np.ndarray
    threshold: np.ndarray
    size: np.ndarray
    samples: int
    columns: tuple[str, ...] = FEATURE_COLUMNS
    scale: np.ndarray | None = None
    spark: SparkSession | None = None

    @property
    def nodes(self) -> DataFrame:
        """The nodes that a row can come to, as a table."""
        there = np.zeros(self.feature.shape, bool)
        there[:, 0] = True
        t, n = np.nonzero(self.feature >= 0)
        there[t, 2 * n + 1] = there[t, 2 * n + 2] = True
        t, n = np.nonzero(there)
        inner = self.feature[t, n] >= 0
        depth = np.floor(np.log2(n + 1)).astype(int)
        table = pd.DataFrame(dict(zip(_NAMES, (t, n, self.feature[t, n].astype(int), self.threshold[t, n], np.where(inner, 2 * n + 1, -1), np.where(inner, 2 * n + 2, -1), self.size[t, n], depth), strict=True)))
        return self.spark.createDataFrame(table, NODES)

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """feature and threshold by tree and node, and path length by tree and node of the last level.

        A leaf hands its path length on to all below it, so every row takes as many steps in every tree.
        """
        if not self.feature.size:
            raise ValueError("the forest is not fitted")
        norms = np.array([path_norm(k) for k in range(int(self.size.max()) + 1)])
        total = self.feature.shape[1]
        inner, ends = self.feature >= 0, np.floor(np.log2(np.arange(total) + 1)) + norms[self.size]
        for n in range(total // 2):
            closed = ~inner[:, n]
            ends[closed, 2 * n + 1] = ends[closed, 2 * n + 2] = ends[closed, n]
        return np.where(inner, self.feature, 0), self.threshold, ends[:, total // 2 :]

    def save(self, path: str) -> None:
        """Nodes, settings and score distribution: without the scale no intensity can be told."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        meta = json.dumps({"samples": self.samples, "columns": list(self.columns)})
        self.spark.createDataFrame([(meta,)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")
        scores = [] if self.scale is None else [(float(s),) for s in self.scale]
        self.spark.createDataFrame(scores, "score double").write.mode("overwrite").parquet(f"{path}/scale")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first().meta)
        scale = np.sort(spark.read.parquet(f"{path}/scale").toPandas()["score"].to_numpy(dtype=float))
        table = spark.read.parquet(f"{path}/nodes").toPandas()
        t, n = table["tree"].to_numpy(), table["node"].to_numpy()
        shape = (int(t.max()) + 1, 2 ** (math.ceil(math.log2(max(2, meta["samples"]))) + 1) - 1)
        feature, threshold, size = np.full(shape, -1, np.int8), np.zeros(shape), np.zeros(shape, np.int32)
        feature[t, n], threshold[t, n], size[t, n] = table["feature"], table["threshold"], table["size"]
        return Forest(feature, threshold, size, meta["samples"], tuple(meta["columns"]), scale, spark)


@dataclass(frozen=True)
class Rows:
    """Numbered training rows: ``frame`` has g from 0 to ``total`` - 1 and, by session, where its numbers start."""

    frame: DataFrame
    days: np.ndarray
    starts: np.ndarray
    counts: np.ndarray

    @property
    def total(self) -> int:
        return int(self.counts.sum())

    def spans(self, mask: np.ndarray | None = None) -> np.ndarray:
        """(first number, rows) of the sessions that ``mask`` lets through."""
        mask = np.ones(len(self.days), bool) if mask is None else mask
        return np.stack([self.starts[mask], self.counts[mask]], 1)


def numbered(features: DataFrame, columns: tuple[str, ...] = FEATURE_COLUMNS) -> Rows:
    """The complete rows of ``features``, numbered by date and symbol; a number is found within its session."""
    rows = features.select("symbol", "dt", *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    found = sorted((str(r.dt), r.n) for r in rows.groupBy("dt").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per session
    counts = np.array([n for _, n in found], np.int64)
    starts = np.cumsum(counts) - counts
    spark = features.sparkSession
    first = spark.createDataFrame([(d, int(x)) for (d, _), x in zip(found, starts, strict=True)], "d string, start long").select(F.to_date("d").alias("dt"), "start")
    inside = F.row_number().over(Window.partitionBy("dt").orderBy("symbol", *columns)) - 1
    frame = rows.withColumn("_in", inside).join(first, "dt").withColumn("g", F.col("start") + F.col("_in")).drop("start", "_in")
    return Rows(frame, np.array([d for d, _ in found], "datetime64[D]"), starts, counts)


def draw(frame: DataFrame, spans: dict[str, np.ndarray], jobs: list[tuple[str, int, int]], seed: int = 0) -> DataFrame:
    """``frame`` (with g) by key and tree: for each job (key, tree, n) n rows drawn without replacement from the key's spans.

    A key's rows are told by number alone, so what is drawn depends neither on
    the layout nor on how many rows there are besides: the numbers are made
    on executors and joined to the rows.
    """
    sent = frame.sparkSession.sparkContext.broadcast(spans)

    def drawn(key: str, tree: int, n: int) -> np.ndarray:
        start, count = sent.value[key].T
        cum = np.cumsum(count)
        total = int(cum[-1])
        rng = np.random.default_rng([seed, zlib.crc32(key.encode()), tree + 1])
        spots = np.arange(total) if n >= total else rng.choice(total, n, replace=False)
        at = np.searchsorted(cum, spots, side="right")
        return start[at] + spots - (cum[at] - count[at])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), JOBS):
                some = pdf.iloc[at : at + JOBS]
                numbers = [drawn(*job) for job in some.itertuples(index=False)]
                sizes = [len(x) for x in numbers]
                yield pd.DataFrame({"key": np.repeat(some["key"].to_numpy(), sizes), "tree": np.repeat(some["tree"].to_numpy(), sizes), "g": np.concatenate(numbers)})

    spark = frame.sparkSession
    asked = spark.createDataFrame(jobs, "key string, tree int, n long").repartition(min(len(jobs), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return asked.mapInPandas(run, "key string, tree int, g long").join(frame, "g")


def fit_each(frame: DataFrame, spans: dict[str, np.ndarray], config: ModelConfig = ModelConfig(), columns: tuple[str, ...] = FEATURE_COLUMNS) -> dict[str, Forest]:
    """A forest for each key of ``spans``, grown in one job from the numbered rows ``frame`` (g, complete features).

    A tree's sample is ``samples`` rows of all its key's, a key's scale the
    scores of ``max_scores`` of them.
    """
    spark, seed, names = frame.sparkSession, config.seed, list(columns)
    totals = {k: int(v[:, 1].sum()) for k, v in spans.items()}
    slim = frame.select("g", *names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, tree = str(pdf["key"].iloc[0]), int(pdf["tree"].iloc[0])
        x = pdf.sort_values("g")[names].to_numpy(dtype=float)
        made = grow(x, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"key": [key], "tree": [tree], **{n: [a.tobytes()] for n, a in zip(("feature", "threshold", "size"), made, strict=True)}})

    jobs = [(k, t, min(config.samples, n)) for k, n in totals.items() for t in range(config.trees)]
    grown = draw(slim, spans, jobs, seed).groupBy("key", "tree").applyInPandas(run, "key string, tree int, feature binary, threshold binary, size binary").collect()
    trees: dict[str, list] = {}
    for r in sorted(grown, key=lambda r: (r.key, r.tree)):
        trees.setdefault(r.key, []).append(r)
    stacked = lambda k, name, kind: np.stack([np.frombuffer(r[name], kind) for r in trees[k]])
    out = {
        k: Forest(stacked(k, "feature", np.int8), stacked(k, "threshold", float), stacked(k, "size", np.int32), min(config.samples, totals[k]), columns, None, spark)
        for k in trees
    }
    some = draw(slim, spans, [(k, -1, min(config.max_scores, n)) for k, n in totals.items()], seed)
    scores = score_each(some, out, "key").select("key", "score").toPandas()  # at most max_scores a key
    for k, part in scores.groupby("key")["score"]:
        out[k].scale = np.sort(part.to_numpy(dtype=float))
    return out


def fit(features: DataFrame, config: ModelConfig = ModelConfig(), columns: tuple[str, ...] = FEATURE_COLUMNS, exclude_dates: DataFrame | None = None) -> Forest:
    """Grow all trees and take the scale. Rows with a missing feature, and rows of ``exclude_dates`` (dt), are left out; none left raises."""
    kept = features if exclude_dates is None else features.join(exclude_dates.select("dt").distinct(), "dt", "left_anti")
    rows = numbered(kept, columns)
    if not rows.total:
        raise ValueError("no complete rows to fit on")
    return fit_each(rows.frame, {"all": rows.spans()}, config, columns)["all"]


def mean_paths(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean path length of each row of ``x`` over all trees."""
    out, first = np.zeros(len(x)), feature.shape[1] // 2
    levels = (feature.shape[1] + 1).bit_length() - 2
    for a in range(0, len(x), CHUNK):
        part = np.ascontiguousarray(x[a : a + CHUNK])
        flat, base, total = part.ravel(), np.arange(len(part)) * x.shape[1], np.zeros(len(part))
        for f, cut, end in zip(feature, threshold, ends, strict=True):
            at = np.zeros(len(part), np.int64)
            for _ in range(levels):
                right = flat.take(base + f.take(at)) >= cut.take(at)
                at = 2 * at + 1 + right
            total += end.take(at - first)
        out[a : a + CHUNK] = total / len(feature)
    return out


def score_each(rows: DataFrame, forests: dict[str, Forest], key: str) -> DataFrame:
    """``rows`` with score and, where the forest has a scale, intensity, by the forest of the row's ``key``.

    score: 2 ** (-mean path / norm); NULL where a feature is missing. A task
    opens only the forests of its own rows.
    """
    context = rows.sparkSession.sparkContext
    sent = {k: context.broadcast((f.packed(), path_norm(f.samples), f.scale)) for k, f in forests.items()}
    names = list(next(iter(forests.values())).columns) if forests else []

    def scored(x: np.ndarray, k: str) -> tuple[np.ndarray, np.ndarray]:
        packed, norm, scale = sent[k].value
        ok = np.isfinite(x).all(1)
        out, share = np.full(len(x), np.nan), np.full(len(x), np.nan)
        out[ok] = 2 ** (-mean_paths(x[ok], *packed) / norm) if norm else 0.5
        if scale is not None and len(scale):
            share[ok] = np.searchsorted(scale, out[ok], side="right") / len(scale)
        return out, share

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, keys = pdf[[f"_x{i}" for i in range(len(names))]].to_numpy(dtype=float), pdf[key].to_numpy()
            out, share = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            for k in pd.unique(keys):
                mine = keys == k
                if k in sent:
                    out[mine], share[mine] = scored(x[mine], k)
            done = pdf[kept].copy()
            done["score"], done["intensity"] = out, share
            yield done

    kept = [c for c in rows.columns if c not in ("score", "intensity")]
    given = rows.select(*[F.col(c) for c in kept], *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)])
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in kept)
    null = lambda c: F.nullif(F.col(c), F.lit(float("nan"))).alias(c)
    done = given.mapInPandas(run, f"{schema}, score double, intensity double")
    return done.select(*[F.col(f"`{c}`") for c in kept], null("score"), null("intensity"))


def score(features: DataFrame, forest: Forest) -> DataFrame:
    """``features`` with score, and intensity on the forest's own scale."""
    return score_each(features.withColumn("_forest", F.lit("all")), {"all": forest}, "_forest").drop("_forest")
