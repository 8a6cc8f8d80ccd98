"""Licence scan by canonical digest lookup.

Case, punctuation, blanks, copyright lines and equivalent spellings are
normalised; then the digest of the entire text, and of each of its lines
taken as an entire notice, is hash-joined to digests of known licence texts
that went through the same normalisation.

A library of up to LIBRARY_ROWS digests is broadcast, and the lines of a text
are looked up where it is, so nothing is shuffled. A larger one is joined:
line digests go to the library, and only those found, and one row for each
text, come back.

Defined results: null and empty texts have the digest of the empty string and
no licence; repeated rows each get their row; the licence library's digests
never include the empty string's; of two entries with one digest the least id
counts; long texts are read whole; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.llm.common import cut, let
from seismark.llm.license_texts import DIGESTS, LIBRARY, SPELLINGS

COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|©|\(c\))[^\n]*"
#: Everything in ASCII but digits, letters and the line end.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical_lines(text: Column) -> Column:
    """Canonical non-blank lines of a text."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    t = F.regexp_replace(t, PUNCTUATION, " ")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")


#: Digests up to which the library is broadcast.
LIBRARY_ROWS = 5_000
POLICIES = ("none", "permissive", "copyleft", "restricted")


def library(spark: SparkSession, known=LIBRARY, digests=DIGESTS) -> DataFrame:
    """license_id, policy and digest of each known text, and of texts known by their digest alone (distinct digests)."""
    rows = spark.createDataFrame(list(known), "license_id string, policy string, text string")
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    done = rows.select("license_id", "policy", whole.alias("c")).filter(F.col("c") != "").select("license_id", "policy", F.sha2("c", 256).alias("digest"))
    if digests:
        done = done.unionByName(spark.createDataFrame(list(digests), "license_id string, policy string, digest string"))
    return done.groupBy("digest").agg(F.min(F.struct("license_id", "policy")).alias("x")).select("digest", "x.license_id", "x.policy")


def _rank(policy: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, POLICIES)), policy) - 1, F.lit(0))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_sha256, license_id of the whole text, notices (ids of lines), policy (the strictest found).

    ``known``: digest, license_id, policy. Each text is normalised once.
    """
    sha = lambda x: F.sha2(x, 256)
    digests = let(
        canonical_lines(F.col("text")),
        lambda ls: F.struct(sha(F.array_join(ls, " ")).alias("whole"), F.array_distinct(F.transform(ls, sha)).alias("lines")),
    )
    texts = docs.select("doc_id", digests.alias("d")).select("doc_id", F.col("d.whole").alias("text_sha256"), F.col("d.lines").alias("lines"))
    head = known.limit(LIBRARY_ROWS + 1).collect()
    whole = known.select(F.col("digest").alias("text_sha256"), "license_id", F.col("policy").alias("_policy"))
    if len(head) <= LIBRARY_ROWS:
        # the whole text by a hash join, its lines by a map of the same library
        notices = F.create_map(*[x for r in head for x in (F.lit(r.digest), F.struct(F.lit(r.license_id).alias("id"), F.lit(r.policy).alias("policy")))]) if head else None
        found = F.filter(F.transform("lines", lambda x: F.try_element_at(notices, x)), lambda x: x.isNotNull()) if head else F.array().cast("array<struct<id:string,policy:string>>")
        rows = texts.withColumn("n", found).drop("lines").join(F.broadcast(whole), "text_sha256", "left")
    else:
        numbered = cut(texts.withColumn("_row", F.monotonically_increasing_id()))
        lines = numbered.select("_row", F.explode("lines").alias("digest")).join(known, "digest")
        hits = lines.groupBy("_row").agg(F.collect_set(F.struct(F.col("license_id").alias("id"), "policy")).alias("n"))
        rows = numbered.drop("lines").join(hits, "_row", "left").join(whole, "text_sha256", "left")
        rows = rows.withColumn("n", F.coalesce("n", F.array().cast("array<struct<id:string,policy:string>>")))
    ids = F.array_join(F.sort_array(F.array_distinct(F.transform("n", lambda x: x["id"]))), ",")
    rank = F.aggregate("n", _rank(F.col("_policy")), lambda acc, x: F.greatest(acc, _rank(x["policy"])))
    policy = F.element_at(F.array(*map(F.lit, POLICIES)), (rank + 1).cast("int"))
    return rows.select("doc_id", "text_sha256", "license_id", ids.alias("notices"), policy.alias("policy"))


def op5_query(docs: DataFrame) -> DataFrame:
    return scan(docs, library(docs.sparkSession))


def op5_sql() -> str:
    t = "regexp_replace(lower(coalesce(text, '')), '(^|\\n)[ \\t]*(copyright|©|\\(c\\))[^\\n]*', chr(10), 'g')"
    t = rf"regexp_replace({t}, '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')"
    for old, new in SPELLINGS:
        t = f"replace({t}, '{old}', '{new}')"
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    known = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in LIBRARY)
    extra = "".join(f" UNION ALL SELECT '{d}', '{i}', '{p}'" for i, p, d in DIGESTS)
    return f"""
WITH k0(license_id, policy, text) AS (VALUES {known}),
k AS (SELECT digest, min(license_id) AS license_id, min(policy) AS policy FROM (SELECT sha256(array_to_string({lines}, ' ')) AS digest, license_id, policy FROM k0{extra}) GROUP BY 1),
d AS (SELECT doc_id, {lines} AS ls FROM documents),
u AS (SELECT doc_id, ls, sha256(array_to_string(ls, ' ')) AS text_sha256 FROM d),
p AS (SELECT DISTINCT doc_id, sha256(unnest(ls)) AS digest FROM u),
r(policy, r) AS (VALUES ('permissive', 1), ('copyleft', 2), ('restricted', 3)),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, max(r) AS r FROM p JOIN k USING (digest) JOIN r USING (policy) GROUP BY doc_id)
SELECT u.doc_id, u.text_sha256, k.license_id, coalesce(n.notices, '') AS notices,
  (['none', 'permissive', 'copyleft', 'restricted'])[greatest(coalesce(r.r, 0), coalesce(n.r, 0)) + 1] AS policy
FROM u LEFT JOIN k ON k.digest = u.text_sha256 LEFT JOIN r ON r.policy = k.policy LEFT JOIN n ON n.doc_id = u.doc_id"""
