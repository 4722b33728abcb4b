"""Exact deduplication by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes.  Equal blocks get the same integer name
by sorting; then adjacent names are paired and the pairs are named again, until one name is left
for each document.  A name stands for its content and nothing else: hashes only spread the work,
and where two contents share a hash they are told apart by the contents themselves.  Only
DataFrame expressions are used.

Texts are shuffled once, reduced on the map side, so a block that fills a third of the corpus
costs each task one row.  All later rounds move integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch

BLOCK_BYTES = 4096
#: Columns of the result beside those of the documents.
ADDED = ("keep_id", "group_size", "kept", "text_sha256")
NAME_BUCKETS = 256


def _named(distinct: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """Adds ``name``: the place of each row in the order of ``by`` within its hash bucket, and the bucket.

    ``distinct`` holds each key once, so names are unique and depend on the keys alone.
    """
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets))
    ranked = distinct.withColumn("_b", bucket).withColumn(
        "_r", F.row_number().over(Window.partitionBy("_b").orderBy(*by))
    )
    return ranked.withColumn("name", F.col("_r") * F.lit(buckets).cast("long") + F.col("_b")).drop("_b", "_r")


def blocks_of(data: Column, size: int) -> Column:
    """The blocks of a binary column, one empty block for no bytes."""
    last = F.greatest(F.ceil(F.octet_length(data) / F.lit(size)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * F.lit(size) + 1, F.lit(size)))


def identities(
    docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int | None = None
) -> DataFrame:
    """``docs`` without its text, plus ``_level``, ``_name`` and ``_row``.

    Rows have equal (_level, _name) exactly when their texts are equal; a null text counts as
    empty.  ``_row`` numbers the rows in the order of the scan; only where two contents share a hash
    is ``docs`` scanned for it again, so docs should then be a table that reads alike twice.
    """
    spark = docs.sparkSession
    buckets = buckets or max(NAME_BUCKETS, 2 * scratch.partitions(spark))
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    blocks = blocks_of(data, block_bytes)
    base = scratch.keep(
        docs.withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_h", F.transform(blocks, lambda b: F.xxhash64(b)))
        .drop(text),
        "blocks",
    )
    content = docs.select(F.explode(blocks).alias("_c")).withColumn("_h", F.xxhash64("_c"))
    # One row for each hash: with one content for it, the hash orders the block; else content does.
    seen = scratch.keep(
        content.groupBy("_h")
        .agg(F.min("_c").alias("lo"), F.max("_c").alias("hi"))
        .select("_h", (F.col("lo") != F.col("hi")).alias("clash")),
        "block-hashes",
    )
    facts = base.agg(F.max(F.size("_h")).alias("most")).first()
    clash = bool(seen.agg(F.coalesce(F.max("clash"), F.lit(False)).alias("c")).first()["c"])
    items = base.select("_row", F.posexplode("_h").alias("_pos", "_h"))
    if clash:  # two contents of one hash: their rows are named by content instead
        items = _by_content(docs, items, seen, text, block_bytes, buckets)
    else:
        items = items.join(_named(seen.select("_h"), ["_h"], buckets), "_h").select("_row", "_pos", "name")
    level, done = 0, []
    most = facts["most"] or 0
    sized = base.select("_row", F.size("_h").alias("_n"))
    if most > 1:
        items = scratch.keep(items.join(sized, "_row"), "names-0")
    else:
        items = items.withColumn("_n", F.lit(1))
    while True:
        done.append(items.where("_n = 1").select("_row", F.lit(level).alias("_level"), F.col("name").alias("_name")))
        if most <= 1:
            break
        pairs = (
            items.where("_n > 1")
            .groupBy("_row", F.shiftright("_pos", 1).alias("_pos"))
            .agg(
                F.max(F.when(F.col("_pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("_pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
                F.first("_n").alias("_n"),
            )
        )
        pairs = scratch.keep(pairs, f"pairs-{level}")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], buckets)
        items = pairs.join(names, ["a", "b"]).select(
            "_row", "_pos", "name", F.shiftright(F.col("_n") + 1, 1).alias("_n")
        )
        most, level = (most + 1) // 2, level + 1
        items = scratch.keep(items, f"names-{level}")
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return base.drop("_h").join(identity, "_row")


def _by_content(docs, items, seen, text, block_bytes, buckets):
    """Names where some hash has several contents: ordered by (hash, content) for those hashes."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    torn = seen.where("clash").select("_h")
    rows = (
        docs.withColumn("_row", F.monotonically_increasing_id())
        .select("_row", F.posexplode(blocks_of(data, block_bytes)).alias("_pos", "_c"))
        .withColumn("_h", F.xxhash64("_c"))
        .join(torn, "_h", "left_semi")
    )
    rows = scratch.keep(rows, "clashing-blocks")
    named = _named(
        seen.where("not clash").select("_h", F.lit(None).cast("binary").alias("_c")).unionByName(
            rows.select("_h", "_c").distinct()
        ),
        ["_h", "_c"],
        buckets,
    )
    plain = items.join(named.where("_c is null").select("_h", "name"), "_h").select("_row", "_pos", "name")
    content = rows.join(named.where("_c is not null"), ["_h", "_c"]).select("_row", "_pos", "name")
    return plain.unionByName(content)


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows of ``docs`` without their text, and which row of each group of equal texts stays.

    Adds keep_id (``key`` of the row that stays: the largest), group_size, kept and text_sha256; columns of ``docs``
    with one of these names, whatever its case, are replaced; key and text cannot have one.  Defined cases: a null text counts as empty; a null key is smaller than any other; of repeated
    keys one row is kept; an empty table gives an empty result; other columns pass through.
    """
    if {key.lower(), text.lower()} & set(ADDED):
        raise ValueError(f"neither the key nor the text can be named {key} or {text}")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    clash = {"_row", "_h", "_level", "_name", "_top"} & {c.lower() for c in docs.columns}
    renamed = docs.withColumnsRenamed({c: f"__{c}" for c in docs.columns if c.lower() in clash})
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    named = identities(renamed.withColumn("text_sha256", sha), text, block_bytes)
    named = scratch.keep(named, "identities")
    groups = named.groupBy("_level", "_name").agg(
        F.max(F.struct(F.col(key).alias("k"), F.col("_row").alias("r"))).alias("_top"),
        F.count(F.lit(1)).alias("group_size"),
    )
    # As a table of its own: adaptive execution splits a hot group only where both sides are plain shuffles.
    groups = scratch.keep(groups, "groups")
    out = (
        named.join(groups, ["_level", "_name"])
        .withColumn("keep_id", F.col("_top.k"))
        .withColumn("kept", F.col("_row") == F.col("_top.r"))
        .drop("_level", "_name", "_row", "_top")
    )
    return out.withColumnsRenamed({f"__{c}": c for c in docs.columns if c.lower() in clash})


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
