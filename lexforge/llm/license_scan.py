"""Licence scans by canonical digest, in DataFrame functions only.

A text is brought into a canonical form (case, copyright lines, equivalent spellings,
punctuation and white space), and the form's SHA-256 is hash-joined with the digests of
known licences. A match means that the entire text is the licence, however it is set.
The same lookup over a text's lines finds one-line notices; every line is looked up.

Known texts are a DataFrame (license_id, text); the default table is in license_texts.
It is broadcast only when it has at most `BROADCAST_ROWS` rows, counted first, and
joined by shuffle beyond that. The digests of at most `INLINE_ROWS` rows stand in the plan
for the lines, so that only lines with a match leave their row. Of several known texts with one digest the least id wins.
Null and empty texts, and texts without letters or digits, have an empty form and match
nothing. Extra columns are ignored, repeated rows give repeated results, an empty table
an empty result, and texts are whole whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import LICENSES, SPELLINGS, whole_texts

BROADCAST_ROWS, INLINE_ROWS = 20_000, 1_000
#: A line that states a copyright and nothing else a licence is known by.
COPYRIGHT_LINE = "(?md)^[^a-z0-9\\n]*(copyright|\\(c\\)|©)[^\\n]*$"
NOT_WORD = "[^a-z0-9\\x{80}-\\x{10ffff}]+"
INK = "[^\\s]"


def canonical(text: Column) -> Column:
    """The form in which two settings of a licence are equal."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, NOT_WORD, " ")), F.lit(" "))
    for spelling, usual in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    return F.trim(out)


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LICENSES + whole_texts(), "license_id string, text string")


def _lookup(known: DataFrame) -> DataFrame:
    form = canonical(F.col("text"))
    digests = known.filter("license_id is not null").select(F.sha2(form, 256).alias("digest"), "license_id", (F.length(form) > 0).alias("some"))
    table = digests.filter("some").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return F.broadcast(table) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest of the canonical form, license_id of the whole text and notices (ids, comma-joined) of every row of docs(doc_id, text)."""
    known = known_licenses(docs.sparkSession) if known is None else known
    table = _lookup(known)
    few = [r.digest for r in table.limit(INLINE_ROWS + 1).collect()]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(INK)), lambda x: F.sha2(canonical(x), 256))
    if len(few) <= INLINE_ROWS:
        lines = F.filter(lines, lambda x: x.isin(few))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(text), 256).alias("digest"), lines.alias("lines"))
    matched = whole.join(table, "digest", "left").select("doc_id", "digest", "license_id", "lines")
    plain = matched.filter(F.size("lines") == 0).select("doc_id", "digest", "license_id", F.lit("").alias("notices"))
    # rows with lines to look up: a row's own lines are all that its group collects
    some = matched.filter(F.size("lines") > 0).withColumn("row", F.monotonically_increasing_id())
    each = some.select("row", "doc_id", "digest", "license_id", F.explode(F.array_distinct("lines")).alias("line"))
    found = each.join(table.select(F.col("digest").alias("line"), F.col("license_id").alias("notice")), "line", "left")
    noted = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("license_id").alias("license_id"), F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"))
    return plain.unionByName(noted.drop("row"))
