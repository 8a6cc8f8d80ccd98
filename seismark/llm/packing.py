"""Variable-capacity best-fit packing.

Texts are byte-level token sequences (UTF-8 bytes and one end mark). Pieces of
at most the largest permitted length go into bins by best fit, longest first.
A bin of length c costs OVERHEAD + c + c * c / SQUARE: a start, its tokens and
attention, which grows with the square. Where no open bin has room, every
permitted length is tried: it is filled, as far as it goes, from what is still
to be placed, and the length of least cost per token held is opened. So the
lengths are chosen together, by what is left to fill them. At the end each bin
shrinks to the smallest permitted length that holds its contents.

Full-length pieces are bins of their own and never leave the JVM. The rest is
dealt evenly over tasks of a bounded number of pieces, each packed on its own;
what that leaves open is a few poorly filled bins per task (``fill`` reports
the share of capacity used). Pieces are dealt by a hash of their row, so bins
do not depend on how rows are laid out.

Defined results: null and empty texts are one piece of one token (the end
mark); repeated rows are packed each, equal rows being interchangeable (only
where thousands of rows are equal does it depend on the layout which tasks
they are spread over); ties in length are placed by doc_id (nulls last) and
piece; a text longer than the largest length is cut into pieces, none of which
is lost; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seismark.llm.common import cut

LENGTHS = (1024, 2048, 4096, 8192)
#: What opening a bin costs besides its length, and the length at which attention costs as much as the tokens.
OVERHEAD, SQUARE = 64, 65_536
#: Pieces packed together in one task.
TASK_PIECES = 20_000
#: Equal pieces from which they are spread over tasks; there are few such groups, and so many at most are broadcast.
EQUAL_PIECES, BROADCAST_ROWS = 5_000, 500_000


def cost(length: int, overhead: int = OVERHEAD, square: int = SQUARE) -> float:
    return overhead + length + length * length / square


def best_fit(sizes: Iterable[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, square: int = SQUARE) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) of each size, in the order given."""
    sizes, lengths = list(sizes), tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    falling = [-sizes[k] for k in order]
    place = [(0, 0)] * len(sizes)
    room: list[tuple[int, int]] = []  # free space and bin of each open bin
    used: list[int] = []

    def filled(at: int, length: int) -> int:
        """Tokens that a bin of ``length`` could hold: the piece at ``at``, then each longest one after it that fits."""
        free = length + falling[at]
        while free and (at := bisect_left(falling, -free, at + 1)) < len(falling):
            free += falling[at]
        return length - free

    for at, k in enumerate(order):
        n = sizes[k]
        spot = bisect_left(room, (n, -1))
        if spot < len(room):
            free, b = room.pop(spot)
        else:
            held = {c: filled(at, c) for c in lengths if c >= n}
            # a length that its contents do not need is not opened
            free = min((c for c in held if c == next(x for x in lengths if x >= held[c])), key=lambda c: (cost(c, overhead, square) / held[c], c))
            b = len(used)
            used.append(0)
        place[k] = (b, used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    shrunk = [next(c for c in lengths if c >= u) for u in used]
    return [(b, offset, shrunk[b]) for b, offset in place]


def pieces(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """doc_id, piece, n_pieces, start, n_tokens and a hash of row and piece: every text cut at the largest length."""
    most = max(lengths)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    total = F.octet_length(text).cast("long") + 1
    n = F.ceil(F.col("_n") / most).cast("int")
    cutup = docs.select("doc_id", total.alias("_n"), F.xxhash64("doc_id", text).alias("_h")).select("doc_id", "_n", "_h", n.alias("n_pieces"))
    each = cutup.select("doc_id", "_n", "_h", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    start = F.col("piece").cast("long") * most
    return each.select(
        "doc_id", "piece", "n_pieces", start.alias("start"), F.least(F.lit(most), F.col("_n") - start).cast("int").alias("n_tokens"), F.xxhash64("_h", "piece").alias("_h")
    )


def _dealt(rows: DataFrame, task_pieces: int) -> DataFrame:
    """``rows`` with _task: about ``task_pieces`` rows each, by hash; groups of many equal pieces are spread."""
    tasks = max(1, math.ceil(rows.count() / task_pieces))
    many = cut(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= EQUAL_PIECES).select("_h", F.lit(True).alias("_many")))
    marked = rows.join(F.broadcast(many) if many.count() <= BROADCAST_ROWS else many, "_h", "left")
    salt = F.when(F.col("_many"), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.lit(0).cast("long"))
    return marked.withColumn("_task", F.pmod(F.xxhash64("_h", salt), F.lit(tasks))).drop("_many")


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, task_pieces: int = TASK_PIECES, square: int = SQUARE) -> DataFrame:
    """One row per piece: doc_id, piece, n_pieces, start, n_tokens, bin_id, bin_offset, bin_capacity."""
    rows = cut(pieces(docs, lengths))
    kind = dict(docs.dtypes)["doc_id"]

    names = ["doc_id", "piece", "n_pieces", "start", "n_tokens", "bin_id", "bin_offset", "bin_capacity"]

    def run(table: pa.Table) -> pa.Table:
        first = table["_task"][0].as_py() << 32
        # Arrow sorts nulls last
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_h", "ascending")])
        bins, offsets, sizes = zip(*best_fit(table["n_tokens"].to_pylist(), lengths, overhead, square), strict=True)
        made = pa.array([first + b for b in bins], pa.int64()), pa.array(offsets, pa.int32()), pa.array(sizes, pa.int32())
        return pa.Table.from_arrays([*(table[c] for c in names[:5]), *made], names=names)

    schema = f"doc_id {kind}, piece int, n_pieces int, start long, n_tokens int, bin_id long, bin_offset int, bin_capacity int"
    part = _dealt(rows.filter(F.col("n_tokens") < max(lengths)), task_pieces)
    packed = part.select("doc_id", "piece", "n_pieces", "start", "n_tokens", "_h", "_task").groupBy("_task").applyInArrow(run, schema)
    full = _dealt(rows.filter(F.col("n_tokens") == max(lengths)), task_pieces)
    place = F.row_number().over(Window.partitionBy("_task").orderBy("_h", "doc_id", "piece"))
    alone = full.select(
        "doc_id", "piece", "n_pieces", "start", "n_tokens", (-(F.col("_task") * (1 << 32) + place)).cast("long").alias("bin_id"),
        F.lit(0).alias("bin_offset"), F.col("n_tokens").alias("bin_capacity"),
    )
    return packed.unionByName(alone)


def fill(packed: DataFrame) -> DataFrame:
    """By bin capacity: bins, tokens, and the share of their capacity that is used."""
    bins = packed.groupBy("bin_id", "bin_capacity").agg(F.sum("n_tokens").alias("tokens"))
    each = bins.groupBy("bin_capacity").agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"))
    return each.withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("bin_capacity")))


def op9_query(docs: DataFrame) -> DataFrame:
    return pack(docs)
