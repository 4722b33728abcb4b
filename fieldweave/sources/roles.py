"""Role views: fixture tables in the part of voxels, samples, coils, series and images.

Every role is one list of (name, SQL expression), so Spark and an independent SQL engine read the
same definition.  Expressions keep to SQL that both understand; literals with E0 are doubles in
both.  All rows of a table take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

D = "CAST({} AS DOUBLE)".format

VOXEL = [
    ("v", "p_partkey"), ("x", f"({D('p_partkey % 20')} - 9.5E0) * 0.125E0"), ("y", f"({D('floor(p_partkey / 20E0) % 20')} - 9.5E0) * 0.125E0"),
    ("z", f"({D('p_size % 3')} - 1E0) * 0.25E0"), ("b0", f"{D('p_size')} - 25.5E0"), ("masked", "p_size > 2"),
    ("re", "p_retailprice / 1000E0"), ("im", f"({D('p_size')} - 25E0) / 50E0"),
]
SAMPLE = [
    ("p", "s_suppkey"), ("d", "s_suppkey % 8"), ("t", f"{D('s_suppkey % 97')} * 0.0001E0"), ("w", f"1E0 + {D('s_suppkey % 3')} * 0.5E0"),
    *[(f"k{i}", f"({D(f's_suppkey * {2 * i + 3} % 31')} - 15E0) * {s}E0") for i, s in enumerate([0.01, 0.2, 0.2, 0.1, 0.01, 0.01, 0.005, 0.01, 0.01])],
    *[(f"q{i}", f"({D(f's_suppkey * {2 * i + 5} % 29')} - 14E0) * 0.3E0") for i in range(9)],
]
#: Coil maps of the regions as coils: a phase ramp for each.
COIL_RE = f"(1E0 + 0.1E0 * {D('r_regionkey')}) * x + 0.5E0"
COIL_IM = f"(0.3E0 * {D('r_regionkey')} - 0.5E0) * y + 0.1E0"
SIGNAL = [("p", "s_suppkey"), ("c", "r_regionkey"), ("re", f"s_acctbal / 1000E0 + {D('r_regionkey')}"), ("im", f"{D('s_suppkey % 11')} - 5E0 - {D('r_regionkey')}")]
SERIES_VALUE = "value"


def sql(role: list[tuple[str, str]], table: str, where: str = "") -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in role)} FROM {table}{' WHERE ' + where if where else ''}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(df: DataFrame, role: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in role])


def voxels(spark, sf_dir, terms: int = 9) -> DataFrame:
    """(v, x, y, z, b0, masked, re, im, b array)."""
    from ..functions import harmonics

    return view(read(spark, sf_dir, "part"), VOXEL).withColumn("b", harmonics.terms(range(1, terms + 1)))


def samples(spark, sf_dir) -> DataFrame:
    """(p, d, t, w, k array, k_dot array)."""
    rows = view(read(spark, sf_dir, "supplier"), SAMPLE)
    return rows.select("p", "d", "t", "w", F.array(*[f"k{i}" for i in range(9)]).alias("k"), F.array(*[f"q{i}" for i in range(9)]).alias("k_dot"))


def coils(spark, sf_dir) -> DataFrame:
    """(v, c, re, im): every coil on every voxel; there are as many coils as regions."""
    vox = view(read(spark, sf_dir, "part"), VOXEL).where("masked").select("v", "x", "y")
    both = vox.crossJoin(F.broadcast(read(spark, sf_dir, "region").select("r_regionkey")))
    return both.selectExpr("v", "r_regionkey AS c", f"{COIL_RE} AS re", f"{COIL_IM} AS im")


def signal(spark, sf_dir, coil_count: bool = True) -> DataFrame:
    region = read(spark, sf_dir, "region").select("r_regionkey")
    both = read(spark, sf_dir, "supplier").crossJoin(F.broadcast(region if coil_count else region.where("r_regionkey = 0")))
    return both.selectExpr(*[f"{e} AS {n}" for n, e in SIGNAL])


def shots(spark, sf_dir) -> DataFrame:
    """(u, j, value): the events of each user in order of time."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("u"), (F.row_number().over(order) - 1).cast("long").alias("j"), F.col("value").cast("double").alias("value")
    )


def images(spark, sf_dir) -> DataFrame:
    """(n, i, j, x): every embedding as an image of 8 x 8, i fastest."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.posexplode("embedding").alias("at", "x")).select(
        "n", (F.col("at") % 8).alias("i"), F.floor(F.col("at") / 8).cast("int").alias("j"), F.col("x").cast("double").alias("x")
    )


def channels(spark, sf_dir) -> DataFrame:
    """(obs, c, re, im): neighbouring components of an embedding as re and im of 32 channels."""
    e = F.col("embedding")
    at = F.explode(F.sequence(F.lit(0), F.lit(31)))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obs"), e, at.alias("c"))
    return rows.select("obs", "c", F.get(e, F.col("c") * 2).cast("double").alias("re"), F.get(e, F.col("c") * 2 + 1).cast("double").alias("im"))


# The same in SQL for an oracle.
VOX_SQL = sql(VOXEL, "part")
SAMP_SQL = sql(SAMPLE, "supplier")
COIL_SQL = f"SELECT v, r_regionkey AS c, {COIL_RE} AS re, {COIL_IM} AS im FROM ({VOX_SQL}) vx, region WHERE masked"
SIGNAL_SQL = f"SELECT {', '.join(f'{e} AS {n}' for n, e in SIGNAL)} FROM supplier, region"
SHOT_SQL = "SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS j, CAST(value AS DOUBLE) AS value FROM events"
IMAGE_SQL = "SELECT vec_id AS n, (a % 8)::INT AS i, (a // 8)::INT AS j, embedding[a + 1]::DOUBLE AS x FROM embeddings, range(64) r(a)"
CHANNEL_SQL = "SELECT vec_id AS obs, c::INT AS c, embedding[2 * c + 1]::DOUBLE AS re, embedding[2 * c + 2]::DOUBLE AS im FROM embeddings, range(32) r(c)"
