"""Best-fit packing of token sequences by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens.  Every partition packs its own pieces
best fit, longest first; bins with less room than the least bin of all would take are final, as
nothing can join them any more.  The others travel on as items and are packed again in fewer
partitions, round by round, until one partition holds them all, or, where they are too many for
one, a round of as few partitions joins nothing.  A round moves only bins that are still open,
and a task gets about ``MOST_ITEMS`` of them at most.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, scratch

CAPACITY = 2048
#: Open bins one task packs at most, except in the first round, where it packs its split.
MOST_ITEMS = 400_000
#: Partitions shrink by this factor from round to round.
FAN = 8


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers): longest item first, each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some open bin has r tokens of room
    for item, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(item)
            room -= length
        else:
            b, room = len(bins), capacity - length
            bins.append([item])
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


def _lists(values: np.ndarray, first: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def _packed(capacity: int):
    """mapInArrow over one partition: (items, lens, load) -> the same of the bins they fill."""

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        load = table.column("load").to_numpy()
        item_lists = table.column("items").combine_chunks()
        first = np.concatenate([[0], np.cumsum(item_lists.value_lengths().to_numpy())])
        items, lens = item_lists.flatten().to_numpy(), table.column("lens").combine_chunks().flatten().to_numpy()
        bins = best_fit(load, capacity)
        for at in range(0, len(bins), 10_000):
            part = bins[at : at + 10_000]
            rows = np.concatenate([np.asarray(b) for b in part])
            size = first[rows + 1] - first[rows]
            upto = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(first[rows] - upto[:-1], size) + np.arange(upto[-1])
            edge = np.concatenate([[0], np.cumsum([len(b) for b in part])])
            total = np.add.reduceat(load[rows], edge[:-1])
            yield pa.RecordBatch.from_arrays(
                [_lists(items[take], upto[edge], pa.int64()), _lists(lens[take], upto[edge], pa.int32()), pa.array(total, pa.int32())],
                names=["items", "lens", "load"],
            )

    return run


def pieces(docs: DataFrame, tokenizer, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): each text's ids and ``end_id``, cut where longer than ``capacity``.

    All pieces but the first are full.
    """
    scratch.prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        tok = bpe.tokenizer_of(tokenizer)
        for batch in batches:
            row, number, starts, lengths, crcs, kept = [], [], [], [], [], []
            done = 0
            for texts in bpe.text_runs(batch.column(1)):
                flat, first = tok.encode(texts)
                flat = flat.astype("<u4")
                close = np.array([end_id], "<u4").tobytes()
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    raw = flat[a:b].tobytes() + close
                    n = len(raw) // 4
                    at, p = 0, 0
                    size = n % capacity or capacity
                    while at < n:
                        own = raw[4 * at : 4 * (at + size)]
                        row.append(done)
                        number.append(p)
                        starts.append(at)
                        lengths.append(size)
                        crcs.append(zlib.crc32(own))
                        if with_ids:
                            kept.append(own)
                        at, p, size = at + size, p + 1, capacity
                    done += 1
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """The rows of ``items`` with sequence_id and offset: where each stands in a sequence of at most ``capacity``.

    Defined cases: lengths are from 1 to capacity; equal rows are placed one by one; other columns
    pass through, but ones named sequence_id and offset are replaced; an empty table gives an empty one.
    """
    spark, item = items.sparkSession, scratch.unused(items, "item")
    items = scratch.keep(items.drop("sequence_id", "offset").withColumn(item, F.monotonically_increasing_id()), "items")
    bins = items.select(F.array(item).alias("items"), F.array(F.col(length).cast("int")).alias("lens"), F.col(length).cast("int").alias("load"))
    schema = "items array<bigint>, lens array<int>, load int"
    final, parts, before = [], None, None
    while True:
        packed = scratch.keep(bins.mapInArrow(_packed(capacity), schema), "bins")
        least = packed.agg(F.min("load").alias("m")).first()["m"] or 1
        full = F.col("load") > capacity - least
        final.append(packed.where(full))
        open_ = packed.where(~full)
        count = open_.count()
        fewer = max((scratch.partitions(spark) if parts is None else parts) // FAN, -(-count // MOST_ITEMS), 1)
        if count <= 1 or parts == 1 or (fewer == parts and count == before):
            final.append(open_)
            break
        parts, before = fewer, count
        bins = open_.repartition(parts)
    done = final[0]
    for more in final[1:]:
        done = done.unionByName(more)
    placed = done.mapInArrow(_placed, "_item long, sequence_id long, offset long").withColumnRenamed("_item", item)
    return items.join(placed, item).drop(item)


def _placed(batches):
    """mapInArrow: bins -> one row for each item: its bin, named by the bin's first item, and offset."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("items").value_lengths().to_numpy()
        items, lens = batch.column("items").flatten().to_numpy(), batch.column("lens").flatten().to_numpy().astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        upto = np.cumsum(lens) - lens
        yield pa.RecordBatch.from_arrays(
            [pa.array(items), pa.array(np.repeat(items[first], size)), pa.array(upto - np.repeat(upto[first], size))],
            names=["_item", "sequence_id", "offset"],
        )


def pack_documents(docs: DataFrame, tokenizer, end_id: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs whole documents: (key, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    ``tokenizer`` comes from ``bpe.share``.  Null and empty texts are one piece of ``end_id``; rows
    with equal keys stay apart; other columns are not read.
    """
    return pack(pieces(docs, tokenizer, end_id, capacity, key, text, with_ids), capacity)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = bpe.share(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, tokenizer).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
