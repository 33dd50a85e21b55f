"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z.  Each folded text is cut into chunks at places its own content
chooses (a sentence end after ``LEAST`` characters, ``MOST`` at the latest).  A text is then the ordered list of its chunk
identifiers, and only these lists are shuffled and compared.  Identifiers are 64-bit hashes of the chunks; for the lists
that occur more than once the chunks behind each identifier are compared byte by byte (least and greatest chunk per
identifier are the same), and a row with an identifier that stands for two chunks is compared by its whole text.

One row per row of the input.  Of equal texts the row with the largest id stays, null ids last; of repeated rows with that
id exactly one stays.  Null counts as empty; empty texts are equal to each other.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.store import keep

LEAST = 512
MOST = 8192


def fold(text: str = "text") -> Column:
    """Lower-case A-Z only; plain ``lower`` does the same for texts without other letters and is much faster."""
    value = F.coalesce(F.col(text), F.lit(""))
    other = value.rlike(r"[^\x00-\x7F]")
    return F.when(other, F.translate(value, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(value))


def chunks(folded: Column) -> Column:
    pattern = rf"(?s).{{{LEAST},{MOST}}}?(?<=[.,;:!?]\s)|.{{1,{MOST}}}"
    return F.regexp_extract_all(folded, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """Identifier list, digest and a stable number of every row; the texts stay behind."""
    folded = docs.select("doc_id", fold().alias("folded"))
    return keep(folded.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(F.col("folded").cast("binary"), 256).alias("text_sha256"),
        F.transform(chunks(F.col("folded")), lambda c: F.xxhash64(c)).alias("ids")))


def collisions(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Identifiers of repeated recipes that stand for more than one chunk."""
    repeated = rows.groupBy("ids").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and size(ids) > 0").select("ids")
    texts = docs.select(fold().alias("folded")) \
        .select(chunks(F.col("folded")).alias("parts")) \
        .select("parts", F.transform("parts", lambda c: F.xxhash64(c)).alias("ids"))
    parts = texts.join(repeated, "ids", "left_semi").select(F.explode("parts").alias("chunk"))
    return parts.groupBy(F.xxhash64("chunk").alias("id")).agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")) \
        .filter("a <> b").select("id")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row."""
    rows = recipes(docs)
    bad = keep(collisions(docs, rows))
    if bad.isEmpty():
        named = rows.withColumn("exact", F.lit(""))
    else:
        touched = rows.select("row", F.explode("ids").alias("id")).join(bad, "id", "left_semi").select("row").distinct()
        # A row whose identifiers are ambiguous is told apart by the digest of its whole text.
        named = rows.join(touched.withColumn("hit", F.lit(True)), "row", "left") \
            .withColumn("exact", F.when(F.col("hit"), F.col("text_sha256")).otherwise(F.lit(""))).drop("hit")
    best = F.max(F.struct("doc_id", "row")).alias("best")
    groups = named.groupBy("ids", "exact").agg(best, F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, ["ids", "exact"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS f FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY f) AS keep_id, count(*) OVER (PARTITION BY f) AS group_size,
       row_number() OVER (PARTITION BY f ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(f) AS text_sha256
FROM t
"""
