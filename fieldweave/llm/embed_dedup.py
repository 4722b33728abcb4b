"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Each vector is normalised and quantised once to 8 bits with a scale of its own; the length of what
quantisation leaves out is measured, not estimated.  Vectors of one label are cut into tiles, and
only the 8-bit tiles, with a scale and two lengths for each vector, travel to the tile products.
For unit vectors a, b with quantised forms qa, qb and residues of length ea, eb, the cosine differs
from qa . qb by at most |qa| * eb + ea: a pair that is above or below the threshold by more is
settled there.  Pairs in between are handed on, the full vectors they name are fetched, and only
those are computed in double precision.

Equal vectors of a label are one class with a count; a tile pair returns link counts and a
spanning forest of its links, so neither copies nor dense groups are expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, scratch

THRESHOLD = 0.93
TILE = 512
#: Tile pairs of a label are dealt to tasks in squares of so many tiles.
SQUARE = 8
#: Open pairs computed at once.
STEP = 1 << 15
#: Allowance for rounding of the double arithmetic in the bounds.
SLACK = 1e-9


def plain(x: np.ndarray) -> np.ndarray:
    """Rows of x scaled by powers of two so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of x as 8-bit whole numbers, and for each (scale, length of the quantised row, length of the residue)."""
    x = plain(x)
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    back = q * scale[:, None]
    rest = unit - back
    return q.astype(np.int8), np.stack([scale, np.sqrt((back * back).sum(axis=1)), np.sqrt((rest * rest).sum(axis=1))], axis=1)


def settled_pairs(qx: np.ndarray, fx: np.ndarray, qy: np.ndarray, fy: np.ndarray, threshold: float, same: bool):
    """Row numbers (i, j) surely linked, and those of pairs that the bounds leave open; same: only i < j of one tile."""
    # Whole products up to dim * 127**2 are exact in single precision below 2**24.
    dtype = np.float32 if qx.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (qx.astype(dtype) @ qy.astype(dtype).T).astype(np.float64)
    product *= fx[:, :1]
    product *= fy[None, :, 0]
    most = np.outer(fx[:, 1], fy[:, 2])
    most += fx[:, 2:]
    most += SLACK
    i, j = np.nonzero(product + most >= threshold)
    if same:
        i, j = i[i < j], j[i < j]
    sure = product[i, j] - most[i, j] >= threshold
    return (i[sure], j[sure]), (i[~sure], j[~sure])


def exact_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y, one beside the other, have cosine >= threshold in double precision."""
    x, y = plain(x), plain(y)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= threshold


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (i, j)."""
    up: dict[int, int] = {}

    def root(a: int) -> int:
        while up.setdefault(a, a) != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    kept = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[ra] = rb
            kept.append((a, b))
    return kept


FOUND = "kind int, a long, b long, pairs binary"


def _links(ids: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """The rows of FOUND for links between classes i and j of ``ids``: link counts (kind 0) and a forest (kind 1)."""
    n = np.bincount(i, counts[j], len(ids)) + np.bincount(j, counts[i], len(ids))
    hit = np.flatnonzero(n)
    edges = np.array(_forest(i, j), np.int64).reshape(-1, 2)
    kinds = np.concatenate([np.zeros(len(hit), np.int32), np.ones(len(edges), np.int32)])
    left, right = np.concatenate([ids[hit], ids[edges[:, 0]]]), np.concatenate([n[hit].astype(np.int64), ids[edges[:, 1]]])
    return pd.DataFrame({"kind": kinds, "a": left, "b": right, "pairs": [None] * len(kinds)})


def _square(threshold: float):
    """applyInPandas: the 8-bit tiles of one square -> FOUND; kind 2: the open pairs (classes) of tiles a and b."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, row, col = key
        tiles = {}
        for side, tid, members, facts, q in zip(pdf["side"], pdf["tid"], pdf["members"], pdf["facts"], pdf["q"], strict=True):
            ids = np.frombuffer(members, np.int64).reshape(-1, 2)
            own = np.frombuffer(facts, np.float64).reshape(-1, 3), np.frombuffer(q, np.int8).reshape(len(ids), -1)
            tiles[side, tid] = (ids[:, 0], ids[:, 1], *own)
        out = [_links(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for (s, t), (ids, counts, fx, qx) in tiles.items():
            for (s2, t2), (ids2, counts2, fy, qy) in tiles.items():
                if s != 0 or s2 != (0 if row == col else 1) or (row == col and t2 < t):
                    continue
                same = row == col and t == t2
                (i, j), (u, v) = settled_pairs(qx, fx, qy, fy, threshold, same)
                if len(i):
                    at = 0 if same else len(ids)
                    both = (ids, counts) if same else (np.concatenate([ids, ids2]), np.concatenate([counts, counts2]))
                    out.append(_links(*both, i, j + at))
                if len(u):
                    pairs = np.stack([ids[u], ids2[v]], axis=1)
                    out.append(pd.DataFrame({"kind": [2], "a": [t], "b": [t2], "pairs": [np.ascontiguousarray(pairs).tobytes()]}))
        return pd.concat(out, ignore_index=True)

    return run


def _needed(batches):
    """mapInPandas: open pairs of tiles (a, b) -> (a, b, cls), one row for each class they name."""
    for pdf in batches:
        for a, b, pairs in zip(pdf["a"], pdf["b"], pdf["pairs"], strict=True):
            yield pd.DataFrame({"cls": np.unique(np.frombuffer(pairs, np.int64))}).assign(a=a, b=b)[["a", "b", "cls"]]


def _decided(threshold: float):
    """applyInPandas: the open pairs of two tiles and the full vectors they name -> FOUND."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        open_ = pdf["pairs"].notna()
        rows = pdf[~open_].sort_values("cls")
        ids, counts = rows["cls"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        x = np.stack(rows["vec"].to_numpy()).astype(np.float64)
        i, j = np.searchsorted(ids, np.frombuffer(pdf["pairs"][open_].iloc[0], np.int64).reshape(-1, 2)).T
        keep = [exact_pairs(x[i[a : a + STEP]], x[j[a : a + STEP]], threshold) for a in range(0, len(i), STEP)]
        keep = np.concatenate(keep)
        return _links(ids, counts, i[keep], j[keep])

    return run


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas: the classes of one tile -> one row with their numbers and counts, bounds and 8-bit values."""
    ids = np.stack([pdf["cls"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)], axis=1)
    q, facts = quantise(np.stack(pdf["vec"].to_numpy()).astype(np.float64))
    first = pdf.iloc[0]
    return pd.DataFrame(
        {"label": [first["label"]], "d": [first["d"]], "tile": [first["tile"]], "members": [np.ascontiguousarray(ids).tobytes()],
         "facts": [facts.tobytes()], "q": [q.tobytes()]}
    )


def embed_dedup(
    vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
    tile: int = TILE, square: int = SQUARE,
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: links are pairs of one label with cosine >= threshold.

    Defined cases: a vector that is null, empty or zero, holds a null or a non-finite component, or
    has a null label links with nothing and is its own component; vectors of different lengths do
    not link; equal vectors link with each other; a repeated key counts as two vectors of one
    component name; a null key is kept only as nobody's component; other columns are not read; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec"), F.col(label).alias("label"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull(), F.lit(False)))
    # -0.0 equals 0.0; classes are told apart by their values, not by a hash.
    rows = rows.withColumn("vec", F.when(F.col("ok"), F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))))
    classes = rows.where("ok").groupBy("label", "vec").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = scratch.keep(classes.withColumns({"cls": F.monotonically_increasing_id(), "d": F.size("vec")}), "vector-classes")
    kind = vectors.schema[label].dataType.simpleString()
    # One row for each label and length.
    sizes = classes.groupBy("label", "d").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = classes.join(sizes, ["label", "d"]).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    tiles = dealt.select("label", "d", "tile", "cls", "n", "vec").groupBy("label", "d", "tile").applyInPandas(
        _pack, f"label {kind}, d int, tile int, members binary, facts binary, q binary"
    )
    tiles = scratch.keep(tiles.withColumn("tid", F.monotonically_increasing_id()), "tiles").join(sizes, ["label", "d"])
    tiles = tiles.withColumn("block", F.floor(F.col("tile") / square).cast("int"))
    blocks = F.ceil(F.col("tiles") / square).cast("int")
    # Tile block b stands on the left of the squares (b, b..) and on the right of (..b, b).
    what = [F.struct("label", "d").alias("of"), "tid", "members", "facts", "q"]
    left = tiles.withColumn("other", F.explode(F.sequence(F.col("block"), blocks - 1)))
    left = left.select(*what, F.col("block").alias("row"), F.col("other").alias("col"), F.lit(0).alias("side"))
    right = tiles.where("block > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block") - 1)))
    right = right.select(*what, F.col("other").alias("row"), F.col("block").alias("col"), F.lit(1).alias("side"))
    found = scratch.keep(left.unionByName(right).groupBy("of", "row", "col").applyInPandas(_square(threshold), FOUND), "tile-links")
    open_ = found.where("kind = 2").select("a", "b", "pairs")
    need = open_.mapInPandas(_needed, "a long, b long, cls long").join(classes.select("cls", "n", "vec"), "cls")
    both = need.withColumn("pairs", F.lit(None).cast("binary")).unionByName(open_, allowMissingColumns=True)
    decided = scratch.keep(both.groupBy("a", "b").applyInPandas(_decided(threshold), FOUND), "open-links")
    found = found.where("kind < 2").unionByName(decided)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("more"))
    parts = graph.components(found.where("kind = 1").select("a", "b"))
    named = classes.select("cls", "label", "vec", "least", "n").join(counts, "cls", "left")
    named = named.join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(
        "label", "vec", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    out = rows.where("ok").join(named, ["label", "vec"]).select("key", "n_links", "component_id")
    alone = rows.where("not ok").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = out.unionByName(alone)
    return out.select(
        F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def op9_embed_dedup(spark, sf_dir: str) -> DataFrame:
    return embed_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS l FROM v),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.93),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links,
       component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id
"""
