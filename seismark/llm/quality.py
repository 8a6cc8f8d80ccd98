"""Quality rules: a threshold table compiled into one projection.

Measures are integers, and every threshold compares integers, so no rounding
can tip a verdict. Nothing here shuffles: it is one narrow projection.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows are judged one by one, and so are rows without a doc_id; a
measure that ties with its threshold passes; long texts are read whole; an
empty table gives an empty result; other columns pass through untouched,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.llm.common import BLANKS, let, whole_words

SPAN = 8  # words in a repeat window
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of the corpus's four languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are this an from "
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine "
    "de la que el en y a los se del las un por con su para una no es al "
    "et le les des du est pour dans qui par sur au une avec"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a text where ``100 * measure`` is past ``percent`` of ``of``.

    ``side`` is "max" (reject above) or "min" (reject below); the rule speaks
    only where ``of`` is at least ``floor``.
    """

    name: str
    measure: str
    of: str
    side: str
    percent: int
    floor: int = 1

    def broken(self, of: Callable[[str], Column] = F.col) -> Column:
        """``of`` gives a measure by its name."""
        left, right = of(self.measure) * 100, of(self.of) * self.percent
        past = left > right if self.side == "max" else left < right
        return (of(self.of) >= self.floor) & past


#: The production threshold table.
RULES = (
    Rule("too_many_symbols", "n_symbols", "n_words", "max", 10),
    Rule("shouting", "n_exclaims", "n_words", "max", 30),
    Rule("words_too_long", "word_chars", "n_words", "max", 1500),
    Rule("words_too_short", "word_chars", "n_words", "min", 200),
    Rule("no_stop_words", "n_stop_words", "n_words", "min", 2, floor=50),
    Rule("repeated_lines", "n_dup_lines", "n_text_lines", "max", 30, floor=4),
    Rule("stutter", "n_stutter", "n_words", "max", 30, floor=10),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_exclaims", "n_text_lines", "n_stutter")


def _covered(starts: Column, span: int) -> Column:
    """Positions that windows of ``span`` words cover, given sorted starts."""
    n = F.size(starts)
    steps = F.zip_with(F.slice(starts, F.lit(2), n - 1), F.slice(starts, F.lit(1), n - 1), lambda b, a: F.least(F.lit(span), b - a))
    return F.aggregate(steps, F.lit(span), lambda acc, x: acc + x)


def repeat_words(words: Column, span: int = SPAN) -> Column:
    """Words inside windows of ``span`` words that occur at least twice.

    Windows are told apart by their 64-bit digest within one text. Texts in
    which no window repeats, nearly all, skip the sort.
    """
    n = F.size(words)
    digests = F.when(
        n >= span, F.transform(F.sequence(F.lit(1), n - (span - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(span))))
    ).otherwise(F.array().cast("array<bigint>"))

    def repeated(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda x, i: (x["h"] == F.get(pairs, i - 1)["h"]) | (x["h"] == F.get(pairs, i + 1)["h"]),
        )
        return let(F.sort_array(F.transform(same, lambda x: x["p"])), lambda d: _covered(d, span))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, repeated))

    return let(digests, count)


def measures(text: Column) -> Column:
    """One struct of the measures of ``text``."""
    safe = F.coalesce(text, F.lit(""))
    by_words = let(
        whole_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).cast("long").alias("n_stutter"),
        ),
    )
    by_lines = let(
        F.filter(F.split(safe, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_text_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    parts = F.struct(by_words.alias("w"), by_lines.alias("l"))
    return let(
        parts,
        lambda p: F.struct(
            p["w"]["n_words"].alias("n_words"),
            p["w"]["word_chars"].alias("word_chars"),
            F.regexp_count(safe, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            p["l"]["n_dup_lines"].alias("n_dup_lines"),
            p["w"]["n_repeat_words"].alias("n_repeat_words"),
            p["w"]["n_stop_words"].alias("n_stop_words"),
            (F.length(safe) - F.length(F.replace(safe, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
            p["l"]["n_text_lines"].alias("n_text_lines"),
            p["w"]["n_stutter"].alias("n_stutter"),
        ),
    )


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    return (of("n_words") < MIN_WORDS) | (of("n_repeat_words") * 100 > of("n_words") * MAX_REPEAT_PERCENT)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed, the names of broken rules and kept, all from one struct."""

    def verdict(m: Column) -> Column:
        names = F.array(*[F.when(r.broken(lambda k: m[k]), F.lit(r.name)) for r in rules]) if rules else F.array().cast("array<string>")
        return F.struct(*[m[k].alias(k) for k in MEASURES], base_failed(lambda k: m[k]).alias("base_failed"), F.array_compact(names).alias("broken_rules"))

    judged = docs.select("doc_id", let(measures(F.col("text")), verdict).alias("v")).select("doc_id", "v.*")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    The verdict is one expression that measures a text once; no column is
    added, so none can clash, and the filter holds no copies of the measures.
    """

    def good(m: Column) -> Column:
        passed = ~base_failed(lambda k: m[k])
        for r in rules:
            passed = passed & ~r.broken(lambda k: m[k])
        return passed

    return docs.filter(let(measures(F.col("text")), good))


#: DuckDB SQL that gives every row its measures; {source} is the table.
MEASURES_SQL = r"""
qm_d AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
qm_w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM qm_d),
qm_g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM qm_w WHERE len(ws) >= 8)),
qm_r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM qm_g) WHERE c > 1),
qm_c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(8)) AS k FROM qm_r) GROUP BY doc_id),
qm_l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM qm_d),
qm AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
  length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaims,
  len(ls)::BIGINT AS n_text_lines,
  len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_stutter
  FROM qm_w w JOIN qm_l l USING (doc_id) LEFT JOIN qm_c c USING (doc_id))"""


def measures_sql(source: str) -> str:
    return MEASURES_SQL.replace("{source}", source).replace("{stops}", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))))


def _broken_sql(r: Rule) -> str:
    return f"({r.of} >= {r.floor} AND {r.measure} * 100 {'>' if r.side == 'max' else '<'} {r.of} * {r.percent})"


BASE_SQL = f"(n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT})"
BROKEN_SQL = "(" + " OR ".join(_broken_sql(r) for r in RULES) + ")"


def op1_query(docs: DataFrame) -> DataFrame:
    return judge(docs).drop("broken_rules")


def op1_sql() -> str:
    return f"WITH {measures_sql('documents')} SELECT *, {BASE_SQL} AS base_failed, NOT {BASE_SQL} AND NOT {BROKEN_SQL} AS kept FROM qm"
