"""Line deduplication over overlapping windows of three lines, with DataFrame expressions only.

Every run of three consecutive lines is hashed to 128 bits.  Windows that occur more than once
in the corpus are found by one pre-aggregated count; of each, the first occurrence stays and the
later ones are marked.  The marked windows of a document are merged into covered line positions,
and those lines go, except where a first occurrence of a repeated window needs them: so one copy
of every window stays whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

WINDOW = 3


def windows(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(_id, _at, _h1, _h2): each window of ``size`` lines by document and first line."""
    lines = docs.select(F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("t")).alias("_id"), F.split(text, "\n").alias("_l"))
    lines = lines.where(F.size("_l") >= size)
    part = lambda l, i, step: [F.get(l, i + j) for j in range(size)][::step]
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("_l") - size),
        lambda i: F.struct(
            F.xxhash64(*part(F.col("_l"), i, 1)).alias("h1"), F.xxhash64(F.lit(size), *part(F.col("_l"), i, -1)).alias("h2")
        ),
    )
    return lines.select("_id", F.posexplode(hashed).alias("_at", "_h")).select("_id", "_at", "_h.h1", "_h.h2")


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with repeated lines cut from its text, plus n_lines and n_removed.

    First means the smallest (key, hash of the text, line).  Defined cases: a null text stays null
    and has no lines; a text of fewer lines than a window is left alone; rows equal in key and
    text count as one document, so they get the same result; null keys come first; the line
    separator is ``\\n``; other columns pass through, but one named as an added
    column is replaced; an empty table gives an empty one.
    """
    docs = docs.drop("n_lines", "n_removed")
    named = {c: f"__{c}" for c in docs.columns if c.lower() in {"_id", "_cut", "_l", "_x", "_k", "_t"}}
    docs = docs.withColumnsRenamed(named)
    found = scratch.keep(windows(docs, key, text, size), "line-windows")
    repeated = (
        found.groupBy("h1", "h2")
        .agg(F.min(F.struct("_id", "_at")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    # As a table of its own: adaptive execution splits a hot window only where both sides are plain shuffles.
    repeated = scratch.keep(repeated, "repeated-windows")
    marked = found.join(repeated, ["h1", "h2"]).select(
        "_id", "_at", (F.struct("_id", "_at") == F.col("first")).alias("first")
    )
    spread = lambda part: F.flatten(
        F.transform(part, lambda a: F.sequence(a, a + size - 1))
    )
    cut = (
        marked.groupBy("_id")
        .agg(
            F.collect_set(F.when(~F.col("first"), F.col("_at"))).alias("later"),
            F.collect_set(F.when(F.col("first"), F.col("_at"))).alias("kept"),
        )
        .where(F.size("later") > 0)
        .select("_id", F.array_except(spread("later"), spread("kept")).alias("_cut"))
    )
    cut = scratch.keep(cut.select(F.col("_id.k").alias("_k"), F.col("_id.t").alias("_t"), "_cut"), "line-cuts")
    # One plan at every size: the cuts grow with the corpus, so they are never broadcast.
    joined = docs.withColumn("_x", F.xxhash64(text)).join(
        cut.hint("merge"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_x") == F.col("_t")), "left"
    )
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_cut"))
    cleaned = F.when(F.col("_cut").isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    )
    joined = joined.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    joined = joined.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    joined = joined.withColumn("n_removed", F.coalesce(F.size("_cut"), F.lit(0)).cast("long"))
    joined = joined.withColumn("n_removed", F.when(F.col("_cut").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_removed")))
    out = joined.withColumn(text, cleaned).drop("_x", "_k", "_t", "_cut")
    return out.withColumnsRenamed({v: k for k, v in named.items()})


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
win AS (
  SELECT doc_id, unnest(range(0, len(l) - 2)) AS a, l FROM lines WHERE len(l) >= 3),
keyed AS (
  SELECT doc_id, a, l[a + 1 : a + 3] AS w FROM win),
ranked AS (
  SELECT doc_id, a, count(*) OVER (PARTITION BY w) AS n,
         row_number() OVER (PARTITION BY w ORDER BY doc_id, a) AS r FROM keyed),
pos AS (
  SELECT DISTINCT doc_id, unnest(range(a, a + 3)) AS p, r > 1 AS later FROM ranked WHERE n > 1),
cut AS (
  SELECT doc_id, p FROM pos WHERE later EXCEPT SELECT doc_id, p FROM pos WHERE NOT later),
every AS (
  SELECT doc_id, unnest(range(0, len(l))) AS p, unnest(l) AS line FROM lines)
SELECT d.doc_id, len(d.l)::BIGINT AS n_lines, count(c.p)::BIGINT AS n_removed,
       coalesce(string_agg(e.line, chr(10) ORDER BY e.p) FILTER (c.p IS NULL), '') AS text
FROM lines d JOIN every e ON e.doc_id = d.doc_id
LEFT JOIN cut c ON c.doc_id = e.doc_id AND c.p = e.p
GROUP BY d.doc_id, d.l
"""
