"""Benchmark decontamination by a broadcast set of test windows.

Windows of 10 normalised benchmark words (a shorter item is one window) are
broadcast; every whole document is scanned once, each window of its words is
looked up by hash and verified by equality. No shuffle takes place. A set of
windows past ``BLOCK_WINDOWS`` is cut into blocks of that size: each block is
a scan of its own that writes down its hits and lets go of its windows before
the next, so one block is in memory at a time; documents then meet their hits
by doc_id and text digest.

Defined results: null and empty texts have no words and no hits; items
without words have no window; a null item_id reads as the empty string;
repeated rows are judged one by one, and items with equal windows all count;
long texts are read whole; an empty table on either side gives no hits; other
columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.llm.common import cut, free_names, parts

SPAN = 10
#: Windows in one broadcast, about 60 MB in a Python worker at most.
BLOCK_WINDOWS = 200_000

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


class Windows:
    """Item ids of each window, and the window lengths in use."""

    def __init__(self) -> None:
        self.items: dict[bytes, set[str]] = {}
        self.spans: set[int] = set()

    def add(self, window: list[bytes], item: str) -> None:
        self.items.setdefault(b" ".join(window), set()).add(item)
        self.spans.add(len(window))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged half-open word spans that are hit, and the items that occur."""
        hits, found = [], set()
        joined = b" ".join(words)
        at, starts = 0, []
        for w in words:
            starts.append(at)
            at += len(w) + 1
        starts.append(at)
        get = self.items
        for span in self.spans:
            for i, (a, b) in enumerate(zip(starts, starts[span:], strict=False)):
                if joined[a : b - 1] in get:
                    found |= get[joined[a : b - 1]]
                    hits.append((i, i + span))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(hits):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, found


def blocks(benchmark: DataFrame, limit: int = BLOCK_WINDOWS) -> Iterator[Windows]:
    """The benchmark's windows in blocks of at most ``limit`` (one item may overrun its block); one block at least."""
    now, sent = Windows(), 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("binary").alias("t"))
    for row in rows.toLocalIterator():
        words = words_of(None if row.t is None else bytes(row.t))
        for k in range(max(1, len(words) - SPAN + 1) if words else 0):
            now.add(words[k : k + SPAN], row.i)
        if len(now.items) >= limit:
            yield now
            now, sent = Windows(), sent + 1
    if now.items or not sent:
        yield now


HITS = "struct<n_words:bigint,spans:array<struct<start:int,stop:int>>,items:array<string>>"
_ARROW_HITS = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string()))]
)


def _pass(df: DataFrame, sent: Broadcast, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: what the windows of ``sent`` hit in ``text``."""
    names = [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        for batch in parts(batches):
            rows = []
            for t in batch.column(names.index(text)).cast(pa.binary()):
                words = words_of(t.as_py())
                spans, items = windows.find(words)
                rows.append({"n_words": len(words), "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted(items)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW_HITS)], names)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, `{out}` {HITS}")


def scan(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_WINDOWS) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: n_words, spans (hit words, merged) and items of each row."""
    (hits,) = free_names(docs, "hits")
    context, rest = docs.sparkSession.sparkContext, blocks(benchmark, limit)
    first, second = next(rest), next(rest, None)
    if second is None:
        return _pass(docs, context.broadcast(first), "text", hits), hits
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    ids = docs.select("doc_id", "text", digest.alias("digest"))
    found = None
    for block in chain((first, second), rest):
        sent = context.broadcast(block)
        mine = cut(_pass(ids, sent, "text", "h").filter(F.size("h.spans") > 0).select("doc_id", "digest", "h.spans", "h.items").distinct())
        sent.destroy()
        found = mine if found is None else found.unionByName(mine)
    one = found.groupBy("doc_id", "digest").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    one = cut(one.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), _merged(F.col("spans")).alias("spans"), "items"))
    counted = _pass(docs, context.broadcast(Windows()), "text", hits)
    doc, dig, spans, items = free_names(counted, "_doc", "_digest", "_spans", "_items")
    one = one.toDF(doc, dig, spans, items)
    met = counted.join(one, F.col("doc_id").eqNullSafe(F.col(doc)) & (digest == F.col(dig)), "left")
    none = lambda c, like: F.coalesce(F.col(c), F.col(f"{hits}.{like}")).alias(like)
    whole = F.struct(F.col(f"{hits}.n_words").alias("n_words"), none(spans, "spans"), none(items, "items"))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], whole.alias(hits)), hits


def _merged(spans):
    """Overlapping or touching spans of a sorted array, made one."""
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def add(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["stop"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, none, add)


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark window."""
    found, hits = scan(docs, benchmark)
    return found.filter(F.size(f"{hits}.spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents, each without the text from the first to the last word of every hit span."""
    names = docs.columns
    found, hits = scan(docs, benchmark)
    found = found.select(*[F.col(f"`{c}`") for c in names], F.col(f"{hits}.spans").alias(hits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = []
            for text, spans in zip(batch.column(names.index("text")).cast(pa.binary()).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if spans:
                    places = [m.span() for m in _WORD.finditer(text)]
                    for s in reversed(spans):
                        text = text[: places[s["start"]][0]] + text[places[s["stop"] - 1][1] :]
                texts.append(None if text is None else text.decode())
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(k) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))


def op6_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found, h = scan(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)
    hit = F.aggregate(f"{h}.spans", F.lit(0), lambda acc, s: acc + s["stop"] - s["start"]).cast("long")
    return found.select(
        "doc_id", F.col(f"{h}.n_words").alias("n_words"), hit.alias("n_hit"), F.size(f"{h}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{h}.items", ","), 256).alias("items_sha256"), (F.size(f"{h}.spans") > 0).alias("contaminated"),
    )


def op6_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS ws FROM documents),
b AS (SELECT item_id, {words} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i+9], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sp AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i+n-1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sp WHERE len(ws) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
