"""Quality scores from a regularised quadratic discriminant over document statistics.

Every whole text is read once and reduced to a row of counts: code points, words, distinct words,
upper-case letters, symbols and so on.  The counts become logarithms of rates, each smoothed towards
its rate in the corpus, so that a text of few words looks ordinary rather than extreme.  Each class of
the labelled texts is a Gaussian whose covariance is shrunk towards its diagonal and towards the
covariance of both classes.  The score is the logistic of the difference of the log densities:
Mahalanobis distances by Cholesky factors that are computed once and sent to every task, log
determinants, and the classes' shares.

The fit takes all labelled rows: tasks hand on sums and products of the statistics only, as many as
there are statistics squared, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textvec
from .toxicity import fold

#: Per text, in this order.
COUNTS = ("points", "words", "letters", "upper", "symbols", "stops", "marks", "lines", "shouted", "marked", "distinct", "top", "again", "pairs")
#: (count, of how many) of each rate.
RATES = (
    ("letters", "points"), ("upper", "letters"), ("symbols", "points"), ("stops", "words"), ("marks", "points"), ("lines", "words"),
    ("shouted", "words"), ("marked", "words"), ("letters", "words"), ("top", "words"), ("again", "words"), ("pairs", "words"),
)
#: A rate counts as if so many more had been seen at the rate of the corpus.
PRIOR = 20.0
#: Shares of the class's own diagonal and of both classes' covariance in its covariance.
DIAGONAL, POOLED = 0.1, 0.1
#: Least variance of a statistic, as a share of its variance in both classes.
FLOOR = 1e-3

_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[ord(c) for c in "#$%&*|<>{}[]\\^~_=@+"]] = 4
_KIND[[ord(c) for c in ".,;:!?"]] = 5
_KIND[[ord(c) for c in "\"'()-/`"]] = 6
_KIND[192:] = 7  # first byte of a code point beyond ASCII


def runs_of(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct (text, value) starts among all in order, and its text."""
    order = np.lexsort((values, docs))
    v, d = values[order], docs[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return np.flatnonzero(first), d[first]


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of COUNTS for each text of a buffer."""
    n = len(offsets) - 1
    out = np.zeros((n, len(COUNTS)))
    with np.errstate(over="ignore"):
        w = textvec.Words(data, offsets, fold=False)
    kind, at = _KIND[w.data], w.at
    each = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    by_word = lambda mask: np.bincount(w.doc[mask], minlength=n)[:n]
    put = lambda name, values: out.__setitem__((slice(None), COUNTS.index(name)), values)
    put("points", each((w.data & 0xC0) != 0x80))
    put("words", w.count)
    put("letters", each((kind == 1) | (kind == 2) | (kind == 3) | (kind == 7)))
    put("upper", each(kind == 1))
    put("symbols", each(kind == 4))
    put("marks", each((kind == 4) | (kind == 5) | (kind == 6)))
    put("lines", each(w.data == 10))
    if not len(w.start):
        return out
    last, size = kind[w.end - 1], w.end - w.start
    run = np.concatenate([[0], np.cumsum(kind == 1)])
    upper = run[w.end] - run[w.start]
    put("stops", by_word(last == 5))
    put("shouted", by_word((upper > 1) & (2 * upper > size)))
    put("marked", by_word((last == 4) | (kind[w.start] == 4)))
    start, doc = runs_of(w.hash, w.doc)
    put("distinct", np.bincount(doc, minlength=n))
    top = np.zeros(n)
    np.maximum.at(top, doc, np.diff(np.append(start, len(w.hash))))
    put("top", top)
    same = w.doc[1:] == w.doc[:-1]
    put("again", np.bincount(w.doc[1:][same & (w.hash[1:] == w.hash[:-1])], minlength=n))
    with np.errstate(over="ignore"):
        both = textvec.mix(w.hash[:-1] * textvec._MULT + w.hash[1:])[same]
    pairs = w.doc[1:][same]
    put("pairs", np.bincount(pairs, minlength=n) - np.bincount(runs_of(both, pairs)[1], minlength=n))
    return out


def statistics(c: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Rows of COUNTS as transformed statistics; ``base`` holds the corpus's rate of each of RATES."""
    of = {name: c[:, i] for i, name in enumerate(COUNTS)}
    rates = [np.log((of[k] + PRIOR * p + 1e-2) / (of[n] + PRIOR)) for (k, n), p in zip(RATES, base, strict=True)]
    rich = np.log(of["distinct"] + PRIOR) / np.log(of["words"] + PRIOR)
    return np.stack([*rates, rich, np.log(of["words"] + PRIOR)], axis=1)


@dataclass
class Model:
    """Two Gaussians over standardised statistics; ``factors`` caches each one's inverse Cholesky factor.

    Without rows of both classes there are no factors and every score is ``share``.
    """

    base: np.ndarray
    share: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    covariances: np.ndarray | None = None
    factors: list[np.ndarray] = field(default_factory=list)
    offsets: list[float] = field(default_factory=list)

    def __post_init__(self):
        if self.covariances is None:
            return
        for k, share in ((0, 1 - self.share), (1, self.share)):
            low = np.linalg.cholesky(self.covariances[k])
            self.factors.append(np.linalg.inv(low))
            self.offsets.append(float(np.log(share) - np.log(np.diag(low)).sum()))

    def scores(self, c: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of COUNTS."""
        if not self.factors:
            return np.full(len(c), self.share)
        z = (statistics(c, self.base) - self.mean) / self.scale
        density = [b - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, b in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts): the COUNTS of every row's whole text; a null text counts as empty."""
    scratch.prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = textvec.text_buffer(batch.column(1))
            for i, j in textvec.chunks(offsets):
                c = counts(data, offsets[i : j + 1]).astype(np.int64)
                cut = pa.array(np.arange(j - i + 1) * len(COUNTS), pa.int32())
                rows = pa.ListArray.from_arrays(cut, pa.array(c.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), rows], names=["key", "counts"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, counts array<long>").withColumnRenamed("key", key)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(COUNTS)).astype(float)


def _moments(base: np.ndarray):
    """mapInArrow: (counts, y) -> (y, i, j, x): sums of products of statistics i and j by class; the last statistic is 1."""

    def run(batches):
        total = np.zeros((2, len(RATES) + 3, len(RATES) + 3))
        for batch in batches:
            x = statistics(_matrix(batch.column(0)), base)
            x, y = np.concatenate([x, np.ones((len(x), 1))], axis=1), batch.column(1).to_numpy()
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        at = np.nonzero(total)
        columns = [pa.array(a.astype(np.int32)) for a in at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total[at])], names=["y", "i", "j", "x"])

    return run


def discriminant(base: np.ndarray, moments: np.ndarray, diagonal: float = DIAGONAL, pooled: float = POOLED) -> Model:
    """The model from the sums of products [class, i, j] of statistics, the last of which is 1.

    A class of n rows has the share max(pooled, d / (n + d)) of both classes' covariance in its own, d being the number of statistics.
    """
    n = moments[:, -1, -1]
    share = float((n[1] + 1) / (n.sum() + 2))
    if not n.all():
        return Model(base, float(n[1] / n.sum()) if n.sum() else 0.5)
    d = moments.shape[1] - 1
    center = lambda m: (m[:-1, -1] / m[-1, -1], m[:-1, :-1] / m[-1, -1] - np.outer(m[:-1, -1], m[:-1, -1]) / m[-1, -1] ** 2)
    mean, both = center(moments.sum(axis=0))
    scale = np.sqrt(np.maximum(np.diag(both), 1e-12))
    own = [center(m) for m in moments]
    within = sum(k * c for k, (_, c) in zip(n, own, strict=True)) / n.sum()
    unit = lambda c: c / np.outer(scale, scale)
    shrunk = []
    for k, (_, c) in zip(n, own, strict=True):
        p = max(pooled, d / (k + d))
        q = min(diagonal, 1 - p)
        shrunk.append(unit((1 - p - q) * c + q * np.diag(np.diag(c)) + p * within) + FLOOR * np.eye(d))
    return Model(base, share, mean, scale, np.stack([(m - mean) / scale for m, _ in own]), np.stack(shrunk))


def fit(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", diagonal: float = DIAGONAL, pooled: float = POOLED) -> Model:
    """Fits the discriminant on all rows of ``measured`` (from ``measure``) that ``labels`` (key, label) names.

    Labels other than 0 and 1 and null keys are passed over; a key that several rows name counts
    that often.  The base rates come from all of ``measured``.  The driver gets sums only.
    """
    scratch.prepare(measured.sparkSession)
    names = [F.sum(F.col("counts")[i]).alias(name) for i, name in enumerate(COUNTS)]
    total = measured.agg(*names).first()
    base = np.array([(total[k] or 0) / max(total[n] or 0, 1) for k, n in RATES])
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    rows = measured.join(known.hint("merge"), F.col(key) == F.col("k")).select("counts", "y")
    sums = rows.mapInArrow(_moments(base), "y int, i int, j int, x double").groupBy("y", "i", "j").agg(F.sum("x").alias("x"))
    moments = np.zeros((2, len(RATES) + 3, len(RATES) + 3))
    for r in sums.collect():  # 2 * statistics ** 2 rows at most
        moments[r["y"], r["i"], r["j"]] = r["x"]
    return discriminant(base, moments, diagonal, pooled)


def score(measured: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) for every row of ``measured``.

    Defined cases: a null or empty text has the statistics of the corpus's rates and no words;
    repeated rows score alike; an empty table gives an empty one.
    """
    scratch.prepare(measured.sparkSession)
    kind = measured.schema[key].dataType.simpleString()
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(_matrix(batch.column(1))))], names=["key", "score"])

    return measured.select(F.col(key).alias("key"), "counts").mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op12_quality_discriminant(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    measured = scratch.keep(measure(docs), "statistics")
    model = fit(measured, labels.where(fold("doc_id") != 0))
    return score(measured, model).select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
