"""Sharding along a Hilbert curve, with DataFrame expressions only.

Language, source, size and key are quantised to cells by rank: numbers by approximate quantiles of
all rows, names by the share of rows before them in alphabetical order.  So cells are about equally
full and keep the order of their values.  Documents are sorted by the index of their cell on the
Hilbert curve through all dimensions, and the order is cut into runs.  Neighbours on the curve
are neighbours in every dimension, so each shard covers a compact box and the least and
greatest values of its files prune on any of them.

The global order needs no single sort: rows are dealt into ranges of (index, key), summed by
range, and numbered within each range from the sums before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch

SHARDS = 16
BITS = 8


def curve_table(dims: int) -> list[int]:
    """Steps of the Hilbert curve: entry[state << dims | cell] = next state << dims | place on the curve.

    A state is (entry corner, direction) of the current cell, numbered corner * dims + direction.
    """
    full = (1 << dims) - 1
    gray = lambda i: i ^ (i >> 1)
    turn = lambda x, k: ((x << (k % dims)) | (x >> (dims - k % dims))) & full
    place = {gray(w): w for w in range(full + 1)}
    table = []
    for corner in range(full + 1):
        for axis in range(dims):
            for cell in range(full + 1):
                w = place[turn(cell ^ corner, dims - (axis + 1) % dims)]
                enter = gray(2 * ((w - 1) // 2)) if w else 0
                lead = w if w % 2 else max(w - 1, 0)
                along = ((lead ^ (lead + 1)).bit_length() - 1) % dims if w else 0
                state = (corner ^ turn(enter, axis + 1)) * dims + (axis + along + 1) % dims
                table.append(state << dims | w)
    return table


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index on the curve of a cell given by one whole number below 2**bits for each dimension."""
    dims = len(cells)
    states = (dims << dims) - 1
    keep = states.bit_length()
    table = F.array(*[F.lit(x) for x in curve_table(dims)])

    def step(acc: Column, level: Column) -> Column:
        cell = F.lit(0)
        for j, c in enumerate(cells):
            cell = cell.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", c, level).bitwiseAND(F.lit(1)), F.lit(j)))
        state = acc.bitwiseAND(F.lit((1 << keep) - 1).cast("long")).cast("int")
        got = F.get(table, F.shiftleft(state, dims).bitwiseOR(cell))
        index = F.shiftleft(F.shiftright(acc, keep), dims).bitwiseOR(got.bitwiseAND(F.lit((1 << dims) - 1)).cast("long"))
        return F.shiftleft(index, keep).bitwiseOR(F.shiftright(got, dims).cast("long"))

    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.shiftright(F.aggregate(levels, F.lit(0).cast("long"), step), keep)


def number_cells(rows: DataFrame, names: list[str], bits: int) -> list[Column]:
    """Cells below 2**bits of numeric columns by approximate rank among all rows; null: cell 0."""
    top = 1 << bits
    shares = [i / top for i in range(1, top)]
    cuts = rows.agg(*[F.percentile_approx(n, shares, 100 * top).alias(n) for n in names]).first()

    def cell(name: str) -> Column:
        found = cuts[name]
        if not found:
            return F.lit(0)
        table, value = F.array(*[F.lit(x) for x in found]), F.col(name)
        # Binary search: the number of cuts below the value.
        step = lambda at, width: at + F.when(F.get(table, at + width - 1) < value, width).otherwise(F.lit(0))
        return F.coalesce(F.aggregate(F.array(*[F.lit(1 << i) for i in range(bits - 1, -1, -1)]), F.lit(0), step), F.lit(0))

    return [cell(n) for n in names]


def name_cells(rows: DataFrame, name: str, bits: int) -> DataFrame:
    """(name, cell): for each distinct value the share of rows before it in order, in steps of 2**-bits; null comes first."""
    counts = scratch.keep(rows.groupBy(name).agg(F.count(F.lit(1)).alias("_count")), "name-counts")
    placed = numbered(counts, [name], {"_before": F.col("_count")})
    total = counts.agg(F.sum("_count").alias("n")).first()["n"] or 1
    return placed.select(name, F.expr(f"int(_before * {1 << bits} div {total})").alias("cell"))


def numbered(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``sums``, its total over all rows before in ``order`` (which must be total).

    No task sorts more than a range of the rows; of each range one row goes to every task.
    """
    ranged = rows.repartitionByRange(scratch.partitions(rows.sparkSession), *order)
    ranged = scratch.keep(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    bases = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"{n}_of") for n, c in sums.items()])
    bases = bases.select("_range", *[F.coalesce(F.sum(f"{n}_of").over(earlier), F.lit(0)).alias(f"{n}_base") for n in sums])
    out = ranged.withColumns({n: F.sum(c).over(within) - c for n, c in sums.items()}).join(F.broadcast(bases), "_range")
    return out.withColumns({n: F.col(n) + F.col(f"{n}_base") for n in sums}).drop("_range", *[f"{n}_base" for n in sums])


def _placed(slim: DataFrame, shards: int, law: str, bits: int) -> DataFrame:
    """Adds curve, shard and slot to (_key, size, text_crc32, _row[, lang][, source]), _row being unique."""
    slim = scratch.keep(slim, "shard-facts")
    by_number = number_cells(slim, ["size", "_key"], bits)
    names = [c for c in ("lang", "source") if c in slim.columns]
    for i, name in enumerate(names):
        cells = name_cells(slim, name, bits).select(F.col(name).alias(f"_n{i}"), F.col("cell").alias(f"_c{i}"))
        # The names may grow with the corpus, so they are never broadcast; a hot name can be split.
        cells = scratch.keep(cells, "name-cells").hint("merge")
        slim = slim.join(cells, F.col(name).eqNullSafe(F.col(f"_n{i}")))
    slim = slim.withColumn("curve", hilbert_index([*by_number, *[F.col(f"_c{i}") for i in range(len(names))]], bits))
    slim = scratch.keep(slim.select("_key", "size", "text_crc32", "curve", "_row"), "curve")
    weight = F.lit(1).cast("long") if law == "rows" else F.col("size")
    placed = numbered(slim, ["curve", "_key", "text_crc32", "_row"], {"_at": weight, "_rank": F.lit(1).cast("long")})
    total = slim.agg(F.sum(weight).alias("n")).first()["n"] or 1
    placed = scratch.keep(placed.withColumn("shard", F.expr(f"int(_at * {shards} div {total})")), "placed")
    # One row for each shard.
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_rank") - F.col("_first"))


def _facts(docs: DataFrame, key: str, text: str, row: Column) -> DataFrame:
    data = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"),
        *[F.col(c).cast("string").alias(c) for c in ("lang", "source") if c in docs.columns],
        row.alias("_row"),
    )


def shard_by_curve(
    docs: DataFrame, shards: int = SHARDS, law: str = "rows", key: str = "doc_id", text: str = "text", bits: int = BITS
) -> DataFrame:
    """(key, size, text_crc32, curve, shard, slot) for every row of ``docs``.

    ``law`` cuts the order into equal counts (``rows``, at most one apart) or equal sums of size
    (``bytes``, apart by less than one document).  ``key`` is a number; ``lang`` and ``source`` count
    as dimensions where present.  Defined cases: a null text has size 1 and crc 0; null metadata come
    first in order; equal rows get places of their own; other columns are not read; an empty table
    gives no rows.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law: {law}")
    placed = _placed(_facts(docs, key, text, F.monotonically_increasing_id()), shards, law, bits)
    return placed.select(F.col("_key").alias(key), "size", "text_crc32", "curve", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, law: str = "rows", key: str = "doc_id", text: str = "text", bits: int = BITS) -> None:
    """Writes all rows and columns of ``docs`` below path, a folder for each shard, sorted by slot.

    Null and repeated keys and repeated rows are written as often as they stand in ``docs``; a
    column named ``shard`` gives way to the shard's number.
    """
    own = scratch.keep(docs.select(F.struct(*docs.columns).alias("d"), F.monotonically_increasing_id().alias("_row")), "shard-rows")
    slim = own.select(*[F.col("d")[c].alias(c) for c in {key, text, "lang", "source"} & set(docs.columns)], F.col("_row").alias("_at_row"))
    placed = _placed(_facts(slim, key, text, F.col("_at_row")), shards, law, bits)
    placed = placed.select(F.col("_row").alias("_r"), F.col("shard").alias("_s"), F.col("slot").alias("_slot"))
    rows = own.join(placed.hint("merge"), F.col("_row") == F.col("_r")).repartitionByRange("_s", "_slot").sortWithinPartitions("_s", "_slot")
    rows.select(*[F.col("d")[c].alias(c) for c in docs.columns if c != "shard"], F.col("_s").alias("shard")).write.partitionBy("shard").parquet(path)


def op10_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return shard_by_curve(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
