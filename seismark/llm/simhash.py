"""SimHash near-duplicates found by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits, cut into two segments
of 32 bits, have a segment in which they differ by at most one bit: one
segment is equal, or both differ by exactly one bit. Each distinct fingerprint
is indexed under both of its segments and under the 32 variants of its high
segment with one bit taken out; equal keys are joined and verified.

Keys that many fingerprints share (a cluster of near copies) are not expanded
into pairs: there the other segment gets its variants as well, until a key
fixes all but two bits. Such a key holds four fingerprints at most, all within
two bits, and they are tied to the least of them. No link is lost.

Defined results: texts without words (null, empty, blank) have fingerprint
zero and link like others; repeated rows each get their row; a component whose
doc_ids are all null has a null id, and else the least of the others; long
texts are read whole; an empty table gives an empty result; other columns are
not read, and ``keep`` passes them through, whatever their names.

``keep`` leaves one row of each class of near copies. Two bits of 64 find few
of them, so it takes its candidates from the longer fingerprints of
``similar``, whose uncertain bits are left out, and verifies the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from seismark.llm import similar
from seismark.llm.common import cut, free_names, parts, small
from seismark.llm.graph import components, with_least

SEED, SHINGLE, BITS = 42, 3, 2
#: Fingerprints under one key from which variants are cheaper than pairs.
DENSE = 48
CHUNK = 1 << 15
#: Rows of an id and a digest, some 50 bytes each, up to which they are broadcast; past that they are joined by sorting.
BROADCAST_ROWS = 500_000


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    grams = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    n = len(words) - size + 1
    hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) of every whole text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column("text").cast(pa.binary())
            fps = pa.array((fingerprint(t.as_py()) for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks(bits: range, take: int) -> list[int]:
    return [_signed(sum(1 << i for i in c)) for c in combinations(bits, take)]


LOW, HIGH = range(32), range(32, 64)


def _keys() -> list[tuple[int, int]]:
    """(id, bits left out) of each way of keying: the low half, the high half, or the low half and one high bit."""
    low = (1 << 32) - 1
    return [(0, _signed(low)), (1, _signed(low << 32))] + [(2 + k, _signed(low | 1 << 32 + k)) for k in range(32)]


def links(distinct: DataFrame) -> DataFrame:
    """Edges a, b that connect all ``fp`` within two bits of each other.

    ``distinct``: one row per fingerprint. Edges join every pair of such
    fingerprints directly or through others within two bits.
    """
    # many keys of each: dealt out anew, as what comes may be in a few partitions
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    ways = F.array(*[F.struct(F.lit(i).alias("way"), F.lit(m).alias("out")) for i, m in _keys()])
    keyed = distinct.select("fp", F.explode(ways).alias("k")).select(
        "fp", "k.way", F.col("fp").bitwiseAND(F.bitwise_not("k.out")).alias("key")
    )
    shared = cut(
        keyed.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    )
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= BITS
    twos = shared.filter("n = 2").filter(near("a", "b")).select("a", "b")
    crowded = shared.filter("n > 2").select("way", "key", "n")
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded
    members = cut(keyed.join(crowded, ["way", "key"]))
    few = members.filter(F.col("n") <= DENSE).select("way", "key", "fp")
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(
        y, (F.col("x.way") == F.col("y.way")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near("x.fp", "y.fp")
    ).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = members.filter(F.col("n") > DENSE).select("way", "fp")
    longs = lambda xs: F.array(*[F.lit(m) for m in xs])
    one_high = F.expr("shiftleft(1L, 30 + way)")
    outs = (
        F.when(F.col("way") == 0, longs(_masks(LOW, 2)))
        .when(F.col("way") == 1, longs(_masks(HIGH, 2)))
        .otherwise(F.transform(longs(_masks(LOW, 1)), lambda m: m.bitwiseOR(one_high)))
    )
    fine = many.select("fp", F.explode(outs).alias("out")).select("fp", "out", F.col("fp").bitwiseAND(F.bitwise_not("out")).alias("key"))
    tied = fine.groupBy("out", "key").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = tied.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return twos.unionByName(pairs).unionByName(stars).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable).

    Rows meet what is known of their fingerprint in plain joins of tables, so
    adaptive execution can split a fingerprint with a large share of the rows.
    """
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    heads = with_least(cut(distinct.join(roots, "fp")), "root", "first", "head").select("fp", "head")
    named = cut(distinct.join(heads, "fp", "left").select("fp", F.coalesce("head", "first").alias("component_id")))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep(docs: DataFrame) -> DataFrame:
    """One row of each class of similar texts: the least doc_id; of rows that repeat it, the least digest of the text.

    A null doc_id comes after all others. Rows equal in doc_id and text become one of them.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    first = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "digest")
    parts = ("keys", "sketch", "size")
    rows = cut(similar.prints(docs, digest).select(first.alias("first"), "fp", *parts))
    sets = rows.groupBy("fp").agg(F.min("first").alias("first"), *[F.any_value(c).alias(c) for c in parts])
    sets = cut(sets.withColumn("id", F.monotonically_increasing_id()))
    near_id, near_digest = free_names(docs, "_near_id", "_near_digest")
    same = F.col("doc_id").eqNullSafe(F.col(near_id)) & (digest == F.col(near_digest))

    def picked(firsts: DataFrame) -> DataFrame:
        """The doc_id and digest of ``firsts``, marked for broadcast up to a size that is checked."""
        slim = firsts.withColumns({near_id: F.col("first.doc_id"), near_digest: F.col("first.digest")}).drop("first")
        return F.broadcast(slim) if firsts.count() <= BROADCAST_ROWS else slim

    def texts(nodes: DataFrame) -> DataFrame:
        one = picked(cut(sets.select("id", "first").join(nodes, "id", "left_semi")))
        # one text of each set is enough to verify it
        return docs.select("doc_id", "text").join(one, same).select("id", F.col("text").cast("string").alias("text")).dropDuplicates(["id"])

    roots = similar.classes(sets.drop("first", "fp"), texts)
    known = small(roots, BROADCAST_ROWS).withColumnRenamed("node", "id")
    placed = cut(with_least(cut(sets.select("id", "fp", "first").join(known, "id")), "root", "first", "head").select("fp", "head"))
    # the head of every set that is not a class of its own with a single row
    held = sets.select("fp", "first").join(small(placed, BROADCAST_ROWS), "fp", "left").select("fp", F.coalesce("head", "first").alias("head"))
    gone = cut(rows.select("first", "fp").join(cut(held), "fp").filter("first <> head").select("first").distinct())
    kept = docs.join(picked(gone), same, "left_anti")
    repeated = cut(rows.groupBy("first").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("first").join(gone, "first", "left_anti"))
    if repeated.isEmpty():
        return kept
    once = kept.join(picked(repeated), same, "left_semi").withColumn(near_digest, digest).dropDuplicates(["doc_id", near_digest])
    return kept.join(picked(repeated), same, "left_anti").unionByName(once.drop(near_digest))


def op4_query(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
