"""Reversible line deduplication.

The exact state is a posting for every long line of every document and a
reference-count table by line (documents that hold it, and the largest of
them). Lines whose count reaches the limit stand in cuckoo filters, one per
shard of the digest space. A scan asks the filters first, so only lines that
repeat (and a few in ten thousand others) are looked up in the exact table,
which alone decides. Documents can be inserted and deleted at any time: a
batch is merged into counts and filters, and deleting it gives back the state
before it.

Filters and the table of repeated lines are broadcast up to a size that is
checked; then documents are scanned in place and no text moves. Past it, each
line goes to the filter of its shard, the few that pass are joined to the
table, and documents meet the lines they lose. Both ways give the same rows.

Defined results: a null or empty text is one empty line; documents with a
null doc_id count for nothing and keep all lines; rows that share a doc_id
are one document for the counts; the largest doc_id keeps a line, in all of
its rows and as often as they hold it; long texts are read whole; an empty
table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from seismark.llm.common import cut, free_names, parts
from seismark.llm.cuckoo import CuckooFilter

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys in one shard's filter when it is built.
SHARD_KEYS = 30_000
#: Repeated lines up to which filters (about 4 bytes a line) and the exact table (about 24) are broadcast.
BROADCAST_LINES = 500_000
#: Tasks that the lines of one shard are spread over past that; each gets a copy of the shard's filter.
CELLS = 16


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of a line's key, or None for a short line."""
    key = line.strip().lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxh3_128_digest(key)


def shard_of(digest: Column, shards: int) -> Column:
    return F.crc32(digest) % shards


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


@dataclass
class Filters:
    """``table``: shard, blob, checkpointed. ``size``: bytes of all blobs."""

    shards: int
    table: DataFrame
    size: int

    def opened(self) -> Opened:
        return Opened(self.shards, {r.shard: bytes(r.blob) for r in self.table.collect()})


@dataclass
class Opened:
    """All filters at one place."""

    shards: int
    blobs: dict[int, bytes]

    def __post_init__(self) -> None:
        self._ready: dict[int, CuckooFilter] = {}

    def __getstate__(self) -> dict:
        return {"shards": self.shards, "blobs": self.blobs, "_ready": {}}

    def holds(self, digests: list[bytes]) -> np.ndarray:
        keys = _pairs(digests)
        may, part = np.zeros(len(keys), bool), np.fromiter((zlib.crc32(d) % self.shards for d in digests), np.int64, len(keys))
        for s in map(int, np.unique(part)):
            if s in self.blobs:
                if s not in self._ready:
                    self._ready[s] = CuckooFilter.load(self.blobs[s])
                mine = np.flatnonzero(part == s)
                may[mine] = self._ready[s].holds(keys[mine])
        return may


@dataclass
class Keepers:
    """The exact table at one place: digests in order, and the document that keeps each line."""

    high: np.ndarray
    low: np.ndarray
    keeper: list

    @staticmethod
    def of(repeated: DataFrame) -> Keepers:
        rows = repeated.select("digest", "keeper").collect()
        keys = _pairs([bytes(r.digest) for r in rows])
        order = np.argsort(keys[:, 0], kind="stable")
        return Keepers(keys[order, 0], keys[order, 1], [rows[k].keeper for k in order])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        n, out = len(self.high), np.full(len(keys), -1)
        at = np.searchsorted(self.high, keys[:, 0])
        left = np.flatnonzero(at < n)
        left = left[self.high[at[left]] == keys[left, 0]]
        while len(left):  # a second round only where two lines agree in half their digest
            hit = self.low[at[left]] == keys[left, 1]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < n]
            left = left[self.high[at[left]] == keys[left, 0]]
        return out


def _candidates(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, digest of the long lines of each row, each once. Rows without a doc_id have none."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows, digests = [], []
            for k, text in enumerate(batch.column("text").cast(pa.binary())):
                found = {line_key(x, min_chars) for x in (text.as_py() or b"").split(b"\n")} - {None}
                rows.extend([k] * len(found))
                digests.extend(sorted(found))
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary())], ["doc_id", "digest"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    return texts.mapInArrow(run, f"doc_id {kind}, digest binary")


def _filters(changes: DataFrame, shards: int, old: Filters | None) -> Filters | None:
    """Filters after ``changes`` (digest, add): each shard is worked on by one task, on a bounded number of keys. None if one is full."""
    spark = changes.sparkSession
    before = old.table if old else spark.createDataFrame([], "shard long, blob binary")

    def work(now: pa.Table, was: pa.Table) -> pa.Table:
        shard = (now if now.num_rows else was)["shard"][0].as_py()
        add, digests = now["add"].to_pylist(), now["digest"].to_pylist()
        gone, new = [d for d, more in zip(digests, add, strict=True) if not more], [d for d, more in zip(digests, add, strict=True) if more]
        one = CuckooFilter.load(was["blob"][0].as_py()) if was.num_rows else CuckooFilter.sized(len(new))
        if gone:
            one.delete(_pairs(gone))
        fits = not new or one.insert(_pairs(sorted(new)))
        return pa.table({"shard": pa.array([shard], pa.int64()), "blob": pa.array([one.dump() if fits else None], pa.binary())})

    rows = changes.withColumn("shard", shard_of(F.col("digest"), shards)).groupBy("shard")
    table = cut(rows.cogroup(before.groupBy("shard")).applyInArrow(work, "shard long, blob binary"))
    state = table.agg(F.count_if(F.col("blob").isNull()).alias("full"), F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("size")).first()
    return None if state.full else Filters(shards, table, state["size"])


@dataclass
class LineState:
    """postings: digest, doc_id. refs: digest, n_docs, keeper of every line. repeated: those at the limit, ``n_repeated`` of them."""

    postings: DataFrame
    refs: DataFrame
    repeated: DataFrame
    n_repeated: int
    filters: Filters
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS


def _counted(postings: DataFrame) -> DataFrame:
    """The reference counts. Counting by line and document first spreads a line that all documents hold."""
    return postings.groupBy("digest").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))


def _state(postings: DataFrame, refs: DataFrame, min_chars: int, min_docs: int, old: LineState | None = None) -> LineState:
    repeated = cut(refs.filter(F.col("n_docs") >= min_docs))
    n, filters = repeated.count(), None
    if old is not None:
        new, before = repeated.select("digest"), old.repeated.select("digest")
        came = new.join(before, "digest", "left_anti").withColumn("add", F.lit(True))
        went = before.join(new, "digest", "left_anti").withColumn("add", F.lit(False))
        filters = _filters(came.unionByName(went), old.filters.shards, old.filters)
    if filters is None:
        filters = _filters(repeated.select("digest", F.lit(True).alias("add")), max(1, math.ceil(n / SHARD_KEYS)), None)
    return LineState(postings, refs, repeated, n, filters, min_chars, min_docs)


def start(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineState:
    """The state after inserting ``docs`` into nothing."""
    postings = _candidates(docs, min_chars).select("digest", "doc_id")
    return _state(postings, _counted(postings), min_chars, min_docs)


def insert(state: LineState, docs: DataFrame) -> LineState:
    """The state with ``docs`` merged in: only lines of the batch are counted, and added to the counts."""
    batch = cut(_candidates(docs, state.min_chars).select("digest", "doc_id").distinct().join(state.postings, ["digest", "doc_id"], "left_anti"))
    merged = state.refs.unionByName(_counted(batch)).groupBy("digest").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
    return _state(cut(state.postings.unionByName(batch)), cut(merged), state.min_chars, state.min_docs, state)


def delete(state: LineState, doc_ids: DataFrame) -> LineState:
    """The state without the documents named in ``doc_ids`` (doc_id): only lines that they hold are counted again."""
    ids = doc_ids.select("doc_id").distinct()
    touched = cut(state.postings.join(ids, "doc_id", "left_semi").select("digest").distinct())
    left = cut(state.postings.join(ids, "doc_id", "left_anti").select("digest", "doc_id"))
    again = _counted(left.join(touched, "digest", "left_semi"))
    refs = state.refs.join(touched, "digest", "left_anti").unionByName(again)
    return _state(left, cut(refs), state.min_chars, state.min_docs, state)


def save(state: LineState, path: str) -> None:
    """Postings, counts and filters, as Parquet."""
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
    write(state.postings, "postings")
    write(state.refs, "refs")
    write(state.filters.table.withColumn("shards", F.lit(state.filters.shards)), "filters")


def load(spark: SparkSession, path: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineState:
    """A saved state, with its filters as they were."""
    refs, blobs = spark.read.parquet(f"{path}/refs"), spark.read.parquet(f"{path}/filters")
    repeated = refs.filter(F.col("n_docs") >= min_docs)
    about = blobs.agg(F.max("shards").alias("shards"), F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("size")).first()
    filters = Filters(about.shards or 1, blobs.select("shard", "blob"), about["size"])
    return LineState(spark.read.parquet(f"{path}/postings"), refs, repeated, repeated.count(), filters, min_chars, min_docs)


def _routed(lines: DataFrame, filters: Filters) -> DataFrame:
    """The rows of ``lines`` (doc_id, digest) whose shard's filter may hold the digest.

    Lines and filters meet by shard and cell; a task reads them in order and
    holds one filter and one batch at a time.
    """
    kind = dict(lines.dtypes)["doc_id"]
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int")
    null = F.lit(None)
    asked = lines.select(shard_of(F.col("digest"), filters.shards).alias("shard"), cell.alias("cell"), F.lit(1).alias("kind"), null.cast("binary").alias("blob"), "doc_id", "digest")
    sent = filters.table.select("shard", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell"), F.lit(0).alias("kind"), "blob", null.cast(kind).alias("doc_id"), null.cast("binary").alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one = None, None
        for batch in parts(batches):
            place = list(zip(batch.column("shard").to_pylist(), batch.column("cell").to_pylist(), strict=True))
            kinds, kept, k = batch.column("kind").to_pylist(), [], 0
            while k < len(place):
                if kinds[k] == 0:
                    at, one = place[k], CuckooFilter.load(batch.column("blob")[k].as_py())
                    k += 1
                    continue
                stop = k
                while stop < len(place) and kinds[stop] == 1 and place[stop] == place[k]:
                    stop += 1
                if at == place[k]:
                    kept.extend((np.flatnonzero(one.holds(_pairs(batch.column("digest").slice(k, stop - k).to_pylist()))) + k).tolist())
                k = stop
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("digest").take(rows)], ["doc_id", "digest"])

    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = asked.unionByName(sent).repartition(n, "shard", "cell").sortWithinPartitions("shard", "cell", "kind")
    return met.mapInArrow(run, f"doc_id {kind}, digest binary")


def drops(state: LineState, docs: DataFrame) -> DataFrame:
    """doc_id, gone: digests of the lines that the document loses."""
    may = _routed(_candidates(docs, state.min_chars), state.filters)
    # a plain join of two tables, so adaptive execution can split a line that many documents hold
    lost = may.join(state.repeated.select("digest", "keeper"), "digest").filter("doc_id <> keeper")
    return lost.groupBy("doc_id").agg(F.collect_set("digest").alias("gone"))


def apply(state: LineState, docs: DataFrame, carry: list[str] | None = None, digest_only: bool = False) -> DataFrame:
    """Columns ``carry`` of ``docs``, then the text left (its SHA-256 if ``digest_only``), the lines before and the lines dropped.

    The last three are named kept, n_lines and n_dropped, with underscores before them as long as a column of ``carry`` has the name.
    """
    carry = docs.columns if carry is None else carry
    text, gone = free_names(docs, "text_", "gone")
    held = docs.select(*[F.col(f"`{c}`") for c in carry], "doc_id" if "doc_id" not in carry else F.lit(0).alias(free_names(docs, "pad")[0]), F.col("text").cast("string").alias(text))
    at = carry.index("doc_id") if "doc_id" in carry else len(carry)
    small = state.n_repeated <= BROADCAST_LINES
    min_chars, names = state.min_chars, [*carry, *free_names(docs.select(*[F.col(f"`{c}`") for c in carry]), "kept", "n_lines", "n_dropped")]
    sent = docs.sparkSession.sparkContext.broadcast((state.filters.opened(), Keepers.of(state.repeated))) if small else None
    if not small:
        lost = drops(state, docs).withColumnRenamed("doc_id", "_lost").withColumnRenamed("gone", gone)
        key = F.col(held.columns[at])
        # rows without a doc_id lose nothing, so they stay where they are
        some = held.filter(key.isNotNull()).join(lost.select(F.col("_lost").alias(free_names(held, "_lost")[0]), gone), key == F.col(free_names(held, "_lost")[0]), "left")
        held = some.select(*held.columns, gone).unionByName(held.filter(key.isNull()).withColumn(gone, F.lit(None).cast("array<binary>")))

    def lost_here(doc_id, digests: list[bytes | None]) -> set[bytes]:
        """The digests that go, by filter and exact table."""
        mine = sorted({d for d in digests if d is not None})
        if doc_id is None or not mine:
            return set()
        filters, table = sent.value
        may = np.flatnonzero(filters.holds(mine))
        found = table.find(_pairs(mine)[may])
        return {mine[m] for m, f in zip(may.tolist(), found.tolist(), strict=True) if f >= 0 and table.keeper[f] != doc_id}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            kept, total, dropped = [], [], []
            ids = batch.column(at)
            for k, raw in enumerate(batch.column(len(carry) + 1).cast(pa.binary())):
                lines = (raw.as_py() or b"").split(b"\n")
                total.append(len(lines))
                digests = [line_key(x, min_chars) for x in lines]
                out = lost_here(ids[k].as_py(), digests) if small else set(batch.column(len(carry) + 2)[k].as_py() or ())
                if out:
                    lines = [x for x, d in zip(lines, digests, strict=True) if d not in out]
                dropped.append(total[-1] - len(lines))
                left = b"\n".join(lines)
                kept.append(hashlib.sha256(left).hexdigest() if digest_only else left.decode())
            more = [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carry))), *more], names)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return held.mapInArrow(run, f"{schema}, `{names[-3]}` string, `{names[-2]}` long, `{names[-1]}` long")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines dropped from text, and n_chars, where there, counted anew."""
    done = apply(start(docs), docs)
    kept = F.col(f"`{done.columns[-3]}`")
    new = {"text": kept, "n_chars": F.length(kept).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return done.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op7_query(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    done = apply(start(slim), slim, ["doc_id"], digest_only=True)
    return done.select("doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


def op7_sql() -> str:
    return r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, coalesce(k.doc_id <> r.keeper, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""
