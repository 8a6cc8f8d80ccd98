"""URL filter: host and path rules, then a Bloom filter cascade over hosts.

The cascade is built over the complete key universe, the distinct hosts of
the corpus. Level 0 encodes the listed keys; every next level encodes those
keys of the other side that the level before took wrongly, until none is left.
Asking the levels in turn gives exact membership for every key of the
universe, with no join when urls are judged. Keys that no level tells apart
(two that agree in both hashes) are told by name, from an exact tail.

Sizes: a level has 10 bits for each key that it encodes, the first one for
each listed key of the corpus, and the ones after it a hundredth of the keys
they come from; so all levels take about 1.3 MB for a million listed hosts.
They are cut into hash blocks of 16 MB. A task opens the blocks of the keys it
sees; past OPEN_BLOCKS blocks, rows go to the tasks of their block, which open
one at a time.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed, unless the empty host is listed; of equally
long rules the one with the longer host counts; repeated rows are judged one
by one; long urls are read whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seismark.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"),
)

#: The production block list: domains blocked with all their subdomains.
BLOCKED = tuple(
    f"{name}.example.{top}"
    for name in ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x")
    for top in ("com", "net", "org")
)

BITS_PER_KEY, PROBES = 10, 7
#: Positions are taken modulo this prime first, so that keys which meet in one small bitmap part in the next.
PRIME = 2147483647
#: Bytes of bitmap in one broadcast; larger cascades are cut into hash blocks.
BLOCK_BYTES = 16 << 20
#: Levels after which what is left goes to the exact tail, which has a bound of its own.
MAX_LEVELS, MAX_TAIL = 28, 100_000
#: Blocks up to which every task may open all of them.
OPEN_BLOCKS = 8
#: Listed domains up to which they are broadcast to the hosts.
BROADCAST_ROWS = 500_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hashes(key: Column) -> tuple[Column, Column]:
    """Two 48-bit hashes: sums of their small multiples stay below 2**63."""
    low = F.lit((1 << 48) - 1)
    return F.xxhash64(key).bitwiseAND(low), F.xxhash64(key, F.lit(1)).bitwiseAND(low)


@dataclass
class Cascade:
    """Bitmaps by level; a key is listed if the first level that refuses it is odd. What passes all levels is listed if it is in ``tail``."""

    levels: list[np.ndarray]
    tail: frozenset[str] | None = None

    def holds(self, a: np.ndarray, b: np.ndarray, keys: Sequence[str]) -> np.ndarray:
        listed = np.full(len(a), len(self.levels) % 2 == 1)
        open_ = np.ones(len(a), bool)
        for i, bits in enumerate(self.levels):
            into = np.ones(len(a), bool)
            for j in range(PROBES):
                p = (a + (i * PROBES + j) * b) % PRIME % (len(bits) * 64)
                into &= (bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) > 0
            listed[open_ & ~into] = i % 2 == 1
            open_ &= into
        if self.tail is not None:
            for k in np.flatnonzero(open_):
                listed[k] = keys[k] in self.tail
        return listed


def _bitmap(keys: DataFrame, level: int, n: int) -> np.ndarray:
    """The Bloom filter of ``keys`` (a, b): its words are made on executors."""
    words = max(1, math.ceil(n * BITS_PER_KEY / 64))
    spots = F.explode(F.array(*[(F.col("a") + F.col("b") * (level * PROBES + j)) % PRIME % (words * 64) for j in range(PROBES)]))
    bit = F.expr("shiftleft(1L, cast(_p % 64 as int))")
    found = keys.select(spots.alias("_p")).groupBy(F.floor(F.col("_p") / 64).cast("long").alias("w")).agg(F.bit_or(bit).alias("x"))
    out = np.zeros(words, np.int64)
    for row in found.toLocalIterator():
        out[row.w] = row.x
    return out.view(np.uint64)


def _taken(keys: DataFrame, bits: np.ndarray, level: int) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf(T.BooleanType())
    def into(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y, word = a.to_numpy(), b.to_numpy(), sent.value
        ok = np.ones(len(x), bool)
        for j in range(PROBES):
            p = (x + (level * PROBES + j) * y) % PRIME % (len(word) * 64)
            ok &= (word[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) > 0
        return pd.Series(ok)

    return keys.filter(into("a", "b"))


def build(universe: DataFrame, block_bytes: int = BLOCK_BYTES, max_levels: int = MAX_LEVELS) -> list[Cascade]:
    """Cascades by hash block. ``universe``: distinct key, and listed."""
    a, b = _hashes(F.col("key"))
    keys = cut(universe.select("key", a.alias("a"), b.alias("b"), "listed"))
    n = keys.filter("listed").count()
    blocks = max(1, math.ceil(n * BITS_PER_KEY / 8 / block_bytes))
    out = []
    for k in range(blocks):
        mine = keys.filter(F.col("a") % blocks == k)
        now, rest, levels = mine.filter("listed"), mine.filter("NOT listed"), []
        size = now.count()
        while size and len(levels) < max_levels:
            levels.append(_bitmap(now, len(levels), size))
            wrong = cut(_taken(rest, levels[-1], len(levels) - 1))
            now, rest, size = wrong, now, wrong.count()
        tail = None
        if size:
            # all that every level takes: the keys of the last one, and those of the other side that it took wrongly
            names = now.unionByName(rest).filter("listed").select("key").limit(MAX_TAIL + 1).collect()
            if len(names) > MAX_TAIL:
                raise RuntimeError("the cascade does not end: its levels tell too few keys apart")
            tail = frozenset(r.key for r in names)
        out.append(Cascade(levels, tail))
    return out


def with_listed(rows: DataFrame, key: str, cascades: list[Cascade], name: str) -> DataFrame:
    """Add ``name``: exact membership of ``key``, a key of the universe."""
    context, blocks = rows.sparkSession.sparkContext, len(cascades)
    sent = [context.broadcast(c) for c in cascades]
    alone = blocks > OPEN_BLOCKS

    @F.pandas_udf(T.BooleanType())
    def holds(a: pd.Series, b: pd.Series, keys: pd.Series) -> pd.Series:
        x, y, names = a.to_numpy(), b.to_numpy(), keys.tolist()
        part, out = x % blocks, np.zeros(len(x), bool)
        for k in np.unique(part):
            mine = np.flatnonzero(part == k)
            out[mine] = sent[k].value.holds(x[mine], y[mine], [names[m] for m in mine])
            if alone:
                sent[k]._value = None  # rows come block by block, so the next batch has others
        return pd.Series(out)

    a, b = _hashes(F.col(key))
    if alone:
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # hosts of one block are spread by url as well, as a host may have a large share of the rows
        rows = rows.repartition(n, a % blocks, F.pmod(F.monotonically_increasing_id(), F.lit(n))).sortWithinPartitions(a % blocks)
    return rows.withColumn(name, holds(a, b, F.col(key)))


def universe_of(hosts: DataFrame, blocked: DataFrame) -> DataFrame:
    """Distinct ``host`` values as key, listed if one of their suffixes is in ``blocked`` (domain)."""
    keys = cut(hosts.select(F.col("host").alias("key")).distinct())
    domains = cut(blocked.select("domain").distinct())
    domains = F.broadcast(domains) if domains.count() <= BROADCAST_ROWS else domains
    labels = F.split("key", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # past the broadcast a plain join of two tables, which adaptive execution splits where a suffix has many hosts
    hits = keys.select("key", F.explode(suffixes).alias("domain")).join(domains, "domain", "left_semi")
    marks = hits.select("key").distinct().withColumn("listed", F.lit(True))
    return keys.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))


def judge(pages: DataFrame, blocked: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    cascades = build(universe_of(urls, blocked))
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = r.fits(host, path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    asked = with_listed(urls, "host", cascades, "_listed")
    by_list = F.when(F.col("_listed"), "block").otherwise("allow")
    return asked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"))


def op8_query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    return judge(pages, spark.createDataFrame([(d,) for d in BLOCKED], "domain string"))


def op8_sql() -> str:
    fit = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(RULES, key=lambda r: (-len(r.name), -len(r.host)))
    case = lambda what: "CASE " + " ".join(f"WHEN {fit(r)} THEN '{what(r)}'" for r in longest)
    bad = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in BLOCKED)
    return rf"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {case(lambda r: r.name)} END AS rule, {case(lambda r: r.verdict)} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict FROM u"""
