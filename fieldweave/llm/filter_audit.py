"""Interaction audit of quality filters over a histogram of failure masks.

Each document gets a mask with one bit per filter that it fails, built from native expressions; the
filter for repeated texts takes the smallest doc_id of each text from a groupBy.  Counting masks
within a part leaves 2^n cells of (documents, good ones, toxic ones), 32 for five filters.  What any
order of filters keeps, removes, finds removed already or removes alone is a sum over those cells,
so all orders are told from one pass over the texts, however many there are.

Texts are read once and never shuffled: a text is named by its SHA-256, and only (id, part, mask,
name) travel.  Groups of equal texts and labels are reduced on the map side and kept as tables, so
that adaptive execution can split a group that holds a third of all rows.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 200
#: Distinct words, upper-case letters: per cent of words, of code points.
LEAST_DISTINCT, MOST_UPPER = 50, 3
SYMBOLS = "[#$%&*|]"
#: The letter of the filter that looks for the same text under a smaller key; all others look at the text alone.
REPEATED = "E"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of a text (not null) and its words."""
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_UPPER * F.char_length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str | None = "lang", filters=text_filters) -> DataFrame:
    """(id, part, mask): bit i is set where filter i (in the order of letters, REPEATED last) fails.

    A null text counts as empty, a null part as the empty string; a null id is neither smaller nor
    larger than any other, so it neither fails nor causes REPEATED.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")
    rows = docs.select(F.col(key).alias("id"), own.alias("part"), whole.alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", SPACE), ""))
    tests = filters(F.col("t"), F.col("w"))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(tests.values())), F.lit(0))
    rows = scratch.keep(rows.select("id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("name")), "masks")
    groups = rows.groupBy("name").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = scratch.keep(groups, "repeated-texts")
    later = F.when(F.col("id") > F.col("first"), 1 << len(tests)).otherwise(0)
    return rows.join(groups.hint("merge"), "name", "left").select("id", "part", F.col("mask").bitwiseOR(later).alias("mask"))


def cells(marked: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask of a part, and those labelled 1.

    A document that several rows of ``labels`` name is good (toxic) if any of them says so.
    """
    one = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0))
    told = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(one(good).alias("good"), one(toxic).alias("toxic"))
    told = scratch.keep(told, "label-flags")
    flagged = marked.join(told.hint("merge"), "id", "left")
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c)
    return flagged.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("good"), count("toxic"))


def orders(letters: str) -> list[dict]:
    """Every permutation's steps: its letters, the step, the mask of the filters before, and the filter's bit."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    return [
        {"filter_order": "".join(p), "step": i + 1, "before": sum(bit[c] for c in p[:i]), "bit": bit[p[i]]}
        for p in itertools.permutations(letters)
        for i in range(len(p))
    ]


def audit(found: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of filters and step, from cells (part, mask, n, good, toxic).

    Documents of the part: kept after the step, removed by it, redundant (fail its filter but are
    gone), unique_fails (fail its filter alone), good_lost and toxic_lost (removed by it), and
    shapley: what its filter removes, summed over all orders.
    """
    plan = F.from_json(F.lit(json.dumps(orders(letters))), "array<struct<filter_order:string,step:int,before:int,bit:int>>")
    entry = F.struct("mask", "n", "good", "toxic")
    rows = found.groupBy("part").agg(F.collect_list(entry).alias("cells"))  # 2^n cells at most
    rows = rows.select("part", "cells", F.inline(plan))
    before, bit = F.col("before"), F.col("bit")
    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0

    def total(column: str, which) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(which(c["mask"]), c[column]).otherwise(0)).alias

    removed = lambda m: ~gone(m) & fails(m)
    out = rows.select(
        "part", "filter_order", "step", "bit",
        total("n", lambda m: ~gone(m) & ~fails(m))("kept"),
        total("n", removed)("removed"),
        total("n", lambda m: gone(m) & fails(m))("redundant"),
        total("n", lambda m: m == bit)("unique_fails"),
        total("good", removed)("good_lost"),
        total("toxic", removed)("toxic_lost"),
    )
    every = Window.partitionBy("part", "bit")  # one row for each order
    return out.withColumn("shapley", F.sum("removed").over(every)).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str | None = "lang", filters=text_filters,
                 good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """The audit of ``filters`` and REPEATED over ``docs``, by ``part`` (None: all as one).

    Defined cases: null texts are empty and null parts the empty string; null keys have no labels and
    are never repeats; rows equal in key and text are each counted and none of them repeats another;
    labels other than 1 and documents without labels are neither good nor toxic; an empty table gives
    no rows; columns other than those named are not read, so their names cannot clash.
    """
    letters = "".join(filters(F.lit(""), F.array().cast("array<string>"))) + REPEATED
    return audit(cells(masks(docs, key, text, part, filters), labels, key, good, toxic), letters)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return filter_audit(docs, labels)


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
tested AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e FROM split),
flags AS (
  SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
         sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM tested LEFT JOIN flags USING (doc_id) GROUP BY ALL),
letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
perms AS (
  SELECT p.l || q.l || r.l || s.l || u.l AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters u
  WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND len(list_distinct([p.l, q.l, r.l, s.l, u.l])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM perms)),
counted AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
