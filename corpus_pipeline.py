"""The corpus pipeline: toxicity, exact and near duplicates, shared passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's rows as
Parquet in the shared folder and reads them back as the next stage's documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import bpe, exact_dedup, near_dedup, packing, scratch, substring_dedup, toxicity


_run: ContextVar[str] = ContextVar("run", default="")


def _owner(spark: SparkSession) -> str:
    """Whose the tables of a stage are: this session's, and in ``run`` this run's."""
    return f"pipeline-{spark._jsparkSession.sessionUUID()}-{_run.get()}"


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage owns the tables it keeps; those of earlier stages of its run go, as their results are written by now."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.sweep(spark, _owner(spark))
        scratch.release(spark)
        with scratch.owned(_owner(spark)):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of these documents.

    Defined cases: null and empty texts have the score of a text without features; repeated rows are
    judged alike; without labels of both classes nothing is learnt and all stay unless the share of
    toxic labels is over a half; columns pass through whatever their names; an empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(toxicity.fold("doc_id") != 0))
    return toxicity.reject(docs, model)


@stage
def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id stays.

    Defined cases: a null text counts as empty; a null doc_id is smaller than any other; of rows equal
    in doc_id and text one stays; columns pass through whatever their names; an empty table gives an
    empty one.
    """
    own, sha, key = (scratch.unused(docs, n) for n in ("own_sha", "kept_sha", "kept_id"))
    kept = exact_dedup.exact_dedup(docs.select("doc_id", "text")).where("kept")
    kept = kept.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha))
    # Of rows equal in id and text one is kept, so the join must not bring back its twins.
    once = docs.withColumn(own, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).dropDuplicates(["doc_id", own])
    joined = once.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(sha)), "left_semi")
    return joined.drop(own)


@stage
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest doc_id.

    Defined cases: texts without words or null stay; rows equal in doc_id and text stay or go
    together, of those equal in doc_id alone each is judged by its text; a null doc_id is smaller
    than any other; columns pass through whatever their names; an empty table gives an empty one.
    """
    name, key, h = (scratch.unused(docs, n) for n in ("own_name", "gone_id", "gone_hash"))
    # Ids may repeat: a document is named by id and text, ordered by id first.
    named = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias(name), "text")
    found = near_dedup.near_dedup(named, key=name)
    gone = found.where(~F.col("kept")).select(F.col(name)["doc_id"].alias(key), F.col(name)["h"].alias(h)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(h))
    return docs.join(gone.hint("merge"), same, "left_anti")


@stage
def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut; all documents stay.

    Defined cases: a null text stays null; rows equal in doc_id and text are cut alike; n_chars, where
    present, is counted anew, and other columns pass through whatever their names; an empty table
    gives an empty one.
    """
    out = substring_dedup.cut_passages(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's tokens in sequences of at most 2048.

    Defined cases: null and empty texts are one piece of the closing id; rows with equal doc_id are
    packed one by one; other columns are not read; an empty table gives no rows.
    """
    tokenizer = bpe.share(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("substring_dedup", cut_passages),
    ("packing", pack),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents of ``sf_dir``; what earlier stages wrote is deleted at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token, paths = _run.set(uuid.uuid4().hex), []
    try:
        for name, f in STAGES:
            out = f(spark, docs, sf_dir)
            paths.append(f"{scratch.shared_dir(spark)}/fieldweave/pipeline/{name}-{_run.get()}")
            out.write.parquet(paths[-1])
            docs = spark.read.schema(out.schema).parquet(paths[-1])
        scratch.drop(spark, *paths[:-1])
        scratch.sweep(spark, _owner(spark))
    finally:
        _run.reset(token)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
