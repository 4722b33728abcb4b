"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

Two small collections of M keys are made, each key of R minhashes.  Table (i, j) of M * M is
keyed by the pair (u_i, v_j), so 2 * M * R minhashes serve M * M tables of 2 * R minhashes each.
A pair of similarity s meets in some table with probability (1 - (1 - s**R)**M) ** 2.

Documents of equal shingle sets form one class beforehand; only classes are hashed into tables.
A key that no second class has cannot fill a table, so its tables are never built.  Pairs are
taken from the tables (u, v) alone, but within a table they are not all emitted: members are
compared with a leader, verified links are merged into components, and only members of different
components meet again, until each table holds one component or all its pairs across components
have been compared.  So no link is lost that a table shows, and a table of thousands of copies
costs thousands of comparisons.  Before texts are compared, pairs whose one-permutation sketches
lie Z standard deviations below the threshold are passed over.

Sets are compared as 64-bit hashes of their shingles: two sets of n shingles together are counted
wrongly with a probability below n * n / 2**64 (2e-11 for 20,000 shingles).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph, scratch, textvec

KEYS, ROWS = 12, 2
#: Leaders per table and round after the first; up to 1000 the choice is cut short before its shuffle.
LEADERS = 1000
#: A table's members are dealt to tasks in parts of about so many, each with all leaders.
PART = 4096
#: Bins of a class's sketch; a pair at the threshold is passed over about once in 3e6.
BINS, Z = 512, 5.0


def _minhashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """count minhashes of each set (rows); an empty set has only the largest value."""
    factors = np.random.default_rng(77).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), count), np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        values = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for c in range(count):
            out[full, c] = np.minimum.reduceat(values * factors[c], starts)
    return out


def _sketch(k: int, m: int, r: int):
    """mapInArrow: (key, text) -> (key, n_shingles, node, keys of both collections)."""

    def run(batches):
        for batch in batches:
            data, offsets = textvec.text_buffer(batch.column(1))
            node, sizes, keys = [], [], []
            for _, sets in textvec.shingle_sets(data, offsets, k):
                mins = _minhashes(sets, 2 * m * r)
                with np.errstate(over="ignore"):
                    own = np.zeros((len(sets), 2 * m), np.uint64)
                    for j in range(r):
                        own = textvec.mix(own * np.uint64(31) + mins[:, j::r])
                    own = textvec.mix(own + np.arange(1, 2 * m + 1, dtype=np.uint64))
                keys.append(own.astype(np.uint64).view(np.int64))
                sizes += [len(s) for s in sets]
                node += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            flat = np.concatenate(keys).ravel() if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1) * 2 * m, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(node, pa.binary()), lists],
                names=["key", "n", "node", "keys"],
            )

    return run


def bin_sketch(shingles: np.ndarray) -> bytes:
    """One byte for each of BINS ranges of hash values, from the least shingle in it; 0: none."""
    at = np.searchsorted(shingles, np.arange(BINS + 1, dtype=np.uint64) * np.uint64((1 << 64) // BINS - 1))
    at[-1] = len(shingles)
    out = np.zeros(BINS, np.uint8)
    full = at[:-1] < at[1:]
    out[full] = shingles[at[:-1][full]] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def plausible(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, share: float, z: float = Z) -> np.ndarray:
    """Which pairs of sketches (broadcast, bins last) are at most z deviations below that similarity.

    ``sizes`` are the sums of the sizes of both sets.  The bins in use draw from the union without
    replacement: the agreeing ones are hypergeometric, and certain where each member has a bin.
    """
    used = ((a | b) > 0).sum(axis=-1, dtype=np.int32)
    same = ((a == b) & (a > 0)).sum(axis=-1, dtype=np.int32)
    union = np.maximum(sizes / (1 + share), used + 1)
    spread = np.sqrt(share * (1 - share) * used * (1 - used / union))
    return same >= share * used - z * spread - 1


def _screened(share: float):
    """mapInArrow: (a, b, na, nb, sa, sb) -> the pairs (a, b) that are plausible."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sa", "sb"))
            sizes = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(plausible(a, b, sizes, share)))

    return run


def _led(share: float, z: float):
    """mapInArrow over rows (t, part, rank, node, c, n, i, j, keys, sketch) sorted by (t, part, rank): plausible
    pairs of the leaders of a part (rank 0) with its members (rank 1) in other components.

    ``keys`` holds both collections, and the table is that of the i-th key of the first and the j-th of
    the second.  A pair that shares several tables is told by the first of them, a pair of leaders
    by the smaller.  Only the leaders of one part are held; members stream past.
    """

    def arrays(rows):
        nodes = np.array([r[0] for r in rows], object)
        comps = np.array([r[1] for r in rows], object)
        keys = np.frombuffer(b"".join(r[5] for r in rows), np.int64).reshape(len(rows), -1)
        sketches = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(-1, BINS)
        return nodes, comps, np.array([r[2] for r in rows]), keys, sketches

    def compare(leaders, group, left, right):
        heads, comp, size, key, sketch = arrays(leaders)
        own, comps, sizes, keys, sketches = arrays(group)
        chief, half = {n: j for j, n in enumerate(heads)}, keys.shape[1] // 2
        before = np.r_[0 : leaders[0][3], half : half + leaders[0][4]]
        led = np.array([n in chief for n in own])
        for j in range(len(heads)):
            low, high = np.minimum(sizes, size[j]), np.maximum(sizes, size[j])
            near = np.flatnonzero((low >= share * high - 1e-9) & (comps != comp[j]) & ~(led & (own < heads[j])))
            if len(before) and len(near):
                near = near[~(keys[near][:, before] == key[j, before]).any(axis=1)]
            if len(near):
                near = near[plausible(sketch[j], sketches[near], sizes[near] + size[j], share, z)]
                left.extend([heads[j]] * len(near))
                right.extend(own[near])

    def run(batches):
        now, leaders = None, []
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch, left, right, group = whole.slice(at, 2000), [], [], []
                names = ("t", "part", "rank", "node", "c", "n", "i", "j", "keys", "sketch")
                for t, part, rank, *row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                    if (t, part) != now:
                        if group and leaders:
                            compare(leaders, group, left, right)
                        now, leaders, group = (t, part), [], []
                    (group if rank else leaders).append(row)
                if group and leaders:
                    compare(leaders, group, left, right)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return run


def _verified(k: int, percent: int):
    """mapInArrow: (a, b, ta, tb) -> the pairs with 100 * intersection >= percent * union."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch, sides = whole.slice(at, 200), []
                for c in ("ta", "tb"):
                    data, offsets = textvec.text_buffer(batch.column(c))
                    sides.append([s for _, sets in textvec.shingle_sets(data, offsets, k) for s in sets])
                keep = []
                for x, y in zip(*sides, strict=True):
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(len(x) > 0 and len(y) > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, m: int = KEYS, r: int = ROWS
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``.

    Texts are lower-cased in A-Z and split at ASCII white space; a document's set holds its
    distinct runs of k words, or its whole sequence if it has fewer.  Documents with
    100 * intersection >= percent * union are linked; component_id is the smallest key reachable.
    Defined cases: a text without words or null links with nothing; a null key is never the
    smallest unless all of its component are null, and then nothing is kept; rows with equal keys
    are linked by their texts only, and all rows that carry the component's key are kept; other
    columns are not read; an empty table gives no rows.
    """
    scratch.prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        _sketch(k, m, r), f"key {kind}, n long, node binary, keys array<long>"
    )
    base = scratch.keep(base, "sketches")
    nodes = base.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = scratch.keep(nodes, "classes")
    tables = _tables(nodes, m)
    parts = _parts(docs, key, text, nodes, tables, k, percent)
    named = nodes.select("node", "key").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("key").alias("component_id"))
    of_node = named.select("node", "component").join(least, "component").select("node", "component_id")
    out = base.select("key", "n", "node").join(of_node, "node", "left")
    own = F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id"))
    return out.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(F.col("key") == own, F.lit(False)).alias("kept"),
    )


def _tables(nodes: DataFrame, m: int) -> DataFrame:
    """(t, i, j, node): members of each table, keyed by the i-th u and the j-th v, that two classes at least share.

    Of tables with the same members the one of least (i, j) stands for all: near copies share most
    of their tables.  So the first table that two classes share is always there.
    """
    each = nodes.select("node", F.posexplode("keys").alias("i", "u"))
    # As a table of its own: adaptive execution splits a hot key only where both sides are plain shuffles.
    shared = scratch.keep(each.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("u"), "shared-keys")
    live = each.join(shared, "u").groupBy("node").agg(
        F.collect_list(F.when(F.col("i") < m, F.struct("i", "u"))).alias("us"),
        F.collect_list(F.when(F.col("i") >= m, F.struct((F.col("i") - m).alias("j"), F.col("u").alias("v")))).alias("vs"),
    )
    rows = live.where("size(us) > 0 and size(vs) > 0").select("node", F.explode("us").alias("u"), "vs")
    rows = rows.select("node", "u", F.explode("vs").alias("v")).select(F.xxhash64("u.u", "v.v").alias("t"), "u.i", "v.j", "node")
    rows = scratch.keep(rows, "all-tables")
    members = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("c")]
    full = rows.groupBy("t").agg(*members, F.min(F.struct("i", "j", "t")).alias("at")).where("c > 1")
    one = full.groupBy("x", "y", "c").agg(F.min("at").alias("at")).select("at.t")
    return scratch.keep(rows.join(scratch.keep(one, "full-tables"), "t"), "tables")


def _parts(docs, key, text, nodes, tables, k, percent) -> DataFrame:
    """(node, component) of the verified links between all classes which a table brings together."""
    involved = scratch.keep(tables.select("node").distinct(), "involved")
    reps = nodes.join(involved, "node").select("node", F.col("key").alias("_key"), "keys")
    # The representatives grow with the corpus, so they are never broadcast.
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("text"))
    texts = rows.join(reps.drop("keys").hint("merge"), F.col("_k").eqNullSafe(F.col("_key"))).select("node", "text")
    texts = texts.mapInArrow(_same_set(k), "node binary, n int, text string, sketch binary").dropDuplicates(["node"])
    texts = scratch.keep(texts, "texts")
    facts, share = texts.select("node", "n", "sketch"), percent / 100

    def verify(pairs: DataFrame) -> DataFrame:
        for side, t in (("a", "ta"), ("b", "tb")):
            pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(t)), side)
        return scratch.keep(pairs.select("a", "b", "ta", "tb").mapInArrow(_verified(k, percent), "a binary, b binary"), "links")

    # As tables of their own: adaptive execution splits a hot table only where both sides are plain shuffles.
    leader = scratch.keep(tables.groupBy("t").agg(F.min("node").alias("a")), "leaders")
    pairs = tables.join(leader, "t").where("a != node").select("a", F.col("node").alias("b")).distinct()
    for side, x, n in (("a", "sa", "na"), ("b", "sb", "nb")):
        pairs = pairs.join(facts.select(F.col("node").alias(side), F.col("sketch").alias(x), F.col("n").alias(n)), side)
    near = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "na", "nb", "sa", "sb")
    done = scratch.keep(near.mapInArrow(_screened(share), "a binary, b binary"), "compared")
    links = verify(done)
    parts = graph.components(links)
    # The tables that are torn between components are gone through to the end.  First the likely pairs,
    # which join most of what belongs together; then all plausible ones.
    key_bytes = F.unhex(F.array_join(F.transform("keys", lambda u: F.lpad(F.hex(u), 16, "0")), ""))
    facts = scratch.keep(facts.join(reps.select("node", key_bytes.alias("keys")), "node"), "facts")
    members, z = tables, 0.0
    while True:
        scratch.release(docs.sparkSession)
        now = members.join(parts.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
        sizes = now.groupBy("t", "c").agg(F.count(F.lit(1)).alias("s"))
        torn = sizes.groupBy("t").agg(F.max_by("c", F.struct("s", "c")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("s").alias("size"))
        torn = scratch.keep(torn.where("parts > 1").select("t", "top", "size"), "torn")
        now = scratch.keep(now.join(torn, "t"), "torn-tables")
        if now.isEmpty():
            return parts
        order = Window.partitionBy("t").orderBy("node")
        heads = now.where("c != top").withColumn("r", F.row_number().over(order)).where(F.col("r") <= LEADERS).select("t", "node", "i", "j", "c", "size")
        split = F.ceil(F.col("size") / PART).cast("int")
        dealt = heads.withColumns({"part": F.explode(F.sequence(F.lit(0), split - 1)), "rank": F.lit(0)}).unionByName(
            now.select("t", "node", "i", "j", "c", "size").withColumns({"part": F.pmod(F.xxhash64("node"), split).cast("int"), "rank": F.lit(1)})
        )
        dealt = dealt.join(facts, "node").select("t", "part", "rank", "node", "c", "n", "i", "j", "keys", "sketch")
        dealt = dealt.repartition("t", "part").sortWithinPartitions("t", "part", "rank")
        pairs = dealt.mapInArrow(_led(share, z), "a binary, b binary")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = scratch.keep(pairs.join(done, ["a", "b"], "left_anti"), "compared")
        found = verify(fresh)
        if z == Z:
            # Tables of at most LEADERS members outside their largest component are finished now.
            rest = now.where("c != top").groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEADERS).select("t")
            members = now.join(rest, "t").join(heads.select("t", "node"), ["t", "node"], "left_anti").select("t", "node", "i", "j")
        if not found.isEmpty():
            links = links.unionByName(found)
            parts = graph.components(links)
        if z == Z and members.isEmpty():
            return parts
        done, z = done.unionByName(fresh), Z


def _same_set(k: int):
    """mapInArrow: the (node, text) rows whose shingle set has the digest ``node``, with its size and sketch."""

    def run(batches):
        for batch in batches:
            data, offsets = textvec.text_buffer(batch.column(1))
            sets = [s for _, part in textvec.shingle_sets(data, offsets, k) for s in part]
            keep = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == x for s, x in zip(sets, batch.column(0).to_pylist(), strict=True)]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), batch.column(1), pa.array([bin_sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "text", "sketch"]).filter(pa.array(keep, pa.bool_()))

    return run


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_dedup(docs, k=4)
