"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, whatever their order.  Words that differ
by one added or removed letter have keys that differ by that letter's value, and words that differ
by one exchanged letter have a key in common once each is rid of one letter.  So every word is put
under its own key and under its key less each of its letters, and words that meet under a key may be
near: the keys that only one word has are dropped by a count.  For the others the order of letters
is verified: a hash of the letters left must be equal too, and for an exchange the place as well, so
anagrams of one another never form pairs; the words that are left are compared themselves.

Words are counted on the map side, so the most frequent one costs each task one row.  Entries are
numbers, as many as letters, whatever the length of a word.  Under one key, rest and place there are
at most as many words as letters in the alphabet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, textvec

LEAST_LENGTH, LEAST_COUNT, RATIO, POWER = 7, 2, 10, 5
#: Rows that a task hands on at once.
ROWS = 100_000
#: Letters of words; A-Z are lower-cased, the others stay as they are.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(word: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.when(F.char_length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def thinned(word: Column, key: Column, every: int = 31) -> Column:
    """The word, or for one in ``every`` (crc32 of key and word) the word without one code point."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", change=None, length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of letters with at least ``length`` code points and ``least`` occurrences.

    ``change`` (word, key) -> word is applied to each run before it is counted.
    """
    runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))
    words = docs.select(F.col(key).alias("k"), F.explode(runs).alias("w")).select("k", lowered(F.col("w")).alias("w"))
    if change is not None:
        words = words.select(change(F.col("w"), F.col("k")).alias("w")).where(F.char_length("w") >= length)
    return words.groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def letter_values(codes: np.ndarray, power: int = POWER) -> np.ndarray:
    """Each code point to a power, as a wrapping integer."""
    value = codes.astype(np.uint64)
    out = value.copy()
    for _ in range(power - 1):
        out *= value
    return out


def _entries(power: int):
    """mapInArrow: (id, n, word) -> (key, rest, at, fresh, id, n), linear in the letters."""

    def run(batches):
        for batch in batches:
            ids, n, words = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            size = np.array([len(w) for w in words], np.int64)
            if not len(size):
                continue
            code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            doc = np.repeat(np.arange(len(size)), size)
            start = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(len(code)) - start[doc]
            up, down = textvec.powers(int(size.max()) + 2)
            with np.errstate(over="ignore"):
                value = letter_values(code, power)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
                key = total[start[1:]] - total[start[:-1]]
                order = textvec.mix((code.astype(np.uint64) + np.uint64(1)) * textvec._MULT) * up[at]
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(order)])
                whole = total[start[1:]] - total[start[:-1]]
                before = total[:-1] - total[start[doc]]
                rest = before + (whole[doc] - before - order) * down[1]
                less = key[doc] - value
            fresh = at == 0
            fresh[1:] |= code[1:] != code[:-1]
            own = np.arange(len(size))
            columns = (
                np.concatenate([key, less]), np.concatenate([whole, rest]), np.concatenate([np.full(len(size), -1), at]),
                np.concatenate([np.ones(len(size), bool), fresh]), np.concatenate([own, doc]),
            )
            for i in range(0, len(columns[0]), ROWS):
                k, r, a, f, d = (c[i : i + ROWS] for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.view(np.int64)), pa.array(r.view(np.int64)), pa.array(a.astype(np.int32)), pa.array(f), pa.array(ids[d]), pa.array(n[d])],
                    names=["key", "rest", "at", "fresh", "id", "n"],
                )

    return run


def anagram_entries(words: DataFrame, power: int = POWER) -> DataFrame:
    """(key, rest, at, fresh, id, n): each word (id, word, n) under its key (at = -1) and under its key less each letter.

    ``rest`` is a hash of the letters left, in order; ``at`` the place of the letter taken, and ``fresh`` tells
    the first place of a run of one letter, as all of them leave the same.
    """
    scratch.prepare(words.sparkSession)
    rows = words.select("id", "n", "word").where("word != ''")
    return rows.mapInArrow(_entries(power), "key long, rest long, at int, fresh boolean, id long, n long")


def near_words(words: DataFrame, power: int = POWER) -> DataFrame:
    """(id, n, other, m): every word of ``words`` (id, word, n; distinct) with every near one and its count.

    Letters meet by number and hash; the words themselves are compared last, so no near word is a guess.
    """
    entries = scratch.keep(anagram_entries(words, power), "anagram-entries")
    # Keys under which only one word stands propose nothing.
    shared = entries.groupBy("key").agg((F.min("id") != F.max("id")).alias("several")).where("several").select("key")
    shared = scratch.keep(shared, "anagram-keys")
    met = scratch.keep(entries.join(shared.hint("merge"), "key", "left_semi"), "anagram-met")
    place, whole = met.where("at >= 0"), met.where("at < 0")
    twin = place.select("key", "rest", "at", F.col("id").alias("oid"), F.col("n").alias("m"))
    exchanged = place.join(twin.hint("merge"), ["key", "rest", "at"]).where("id < oid").select("id", "n", "oid", "m")
    whole = whole.select("key", "rest", F.col("id").alias("oid"), F.col("n").alias("m"))
    longer = place.where("fresh").join(whole.hint("merge"), ["key", "rest"]).select("id", "n", "oid", "m")
    pairs = scratch.keep(exchanged.unionByName(longer), "anagram-pairs")
    for side, name in (("id", "word"), ("oid", "other")):
        pairs = pairs.join(words.select(F.col("id").alias(side), F.col("word").alias(name)).hint("merge"), side)
    near = scratch.keep(pairs.where(F.levenshtein("word", "other", 1) == 1), "near-words")
    back = near.select(F.col("oid").alias("id"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m"))
    return near.select("id", "n", "other", "m").unionByName(back)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of ``forms`` (word, form): forms are followed to the last one.

    Each round doubles the steps followed; forms never lead back, as each is more frequent than its word.
    """
    spark = forms.sparkSession
    now = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = scratch.keep(now.join(ahead.hint("merge"), "root", "left").select("word", "root", "further"), "steps")
        if stepped.where("further is not null").isEmpty():
            return now
        now = stepped.select("word", F.coalesce("further", "root").alias("root"))
        scratch.release(spark)


def spelling_variants(words: DataFrame, ratio: int = RATIO, power: int = POWER) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n).

    Near words differ by one inserted, deleted or replaced code point.  A word's form is its near word
    of largest n (ties: smallest in code-point order) if that n is at least ``ratio`` times its own, else
    null; root is the last form reached, the word itself without one.  Defined cases: rows of one word
    count as one with the sum of their n, null words are left out, an empty table gives an empty one, and
    other columns are not read.
    """
    words = words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.keep(words.withColumn("id", F.monotonically_increasing_id()), "words")
    best = near_words(words, power).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("w"))).alias("b")
    )
    best = words.join(best.hint("merge"), "id", "left")
    frequent = -F.col("b.m") >= ratio * F.col("n")
    best = best.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, F.col("b.w")).alias("form"), F.when(frequent, -F.col("b.m")).alias("form_n"),
    )
    best = scratch.keep(best, "forms")
    last = roots(best.where("form is not null"))
    out = best.join(last.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(word_counts(docs, change=thinned))


ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT b, b AS v, 0 AS i FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8),
crc AS (
  SELECT list(v ORDER BY b) AS t FROM bits WHERE i = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents),
long AS (
  SELECT w, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs WHERE length(w) >= 7),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
                            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS h
  FROM long, crc),
cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word FROM hashed),
words AS (
  SELECT word, count(*) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
less AS (
  SELECT word, n, i AS at, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
shorter AS (
  SELECT DISTINCT l.word AS long_word, l.n AS long_n, w.word AS short_word, w.n AS short_n FROM less l JOIN words w ON w.word = l.rest),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.at = b.at AND a.word <> b.word
  UNION ALL SELECT long_word, long_n, short_word, short_n FROM shorter
  UNION ALL SELECT short_word, short_n, long_word, long_n FROM shorter),
best AS (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word, n),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word, n)),
walk AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN walk w ON w.word = f.word WHERE w.next IS NULL
"""
