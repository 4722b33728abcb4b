"""Toxicity scores from a counterfactual-regularised linear classifier.

A text's features are its distinct words and the word beginnings of 3 to 7 bytes, hashed to 64
bits, so length does not matter and a single passage in a long text counts fully.  The features
that best separate the classes in a bounded sample of labelled texts get weights by logistic
regression.  Sentences of the sample that name a group are rewritten with another group's name,
and the loss adds the squared change of the score: the name itself then cannot carry toxicity.

Only the sample's feature counts and the chosen columns reach the driver, both bounded by the
parameters; scoring reads every whole text once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, textvec

#: Labelled texts of each class to learn from, at most.
SAMPLE = 2500
#: Features with a weight, at most.
FEATURES = 512
#: A feature must be in so many texts of the sample.
LEAST_TEXTS = 3
PREFIXES = (3, 4, 5, 6, 7)
L2, COUNTERFACTUAL, STEPS = 1e-4, 1.0, 500
#: A feature must raise the log likelihood of the sample by so much.
LEAST_GAIN = 5.0
#: How far the bias moves from equal classes towards their real share.
SHARE = 0.5

# Names of groups; within a line, one can stand for another.
GROUPS = (
    "women men", "woman man", "girls boys", "girl boy", "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist", "black white asian latino", "blacks whites asians latinos",
    "gay straight", "lesbian heterosexual", "gays heterosexuals", "immigrants natives refugees", "immigrant native refugee",
    "transgender cisgender", "disabled deaf blind", "old young", "africans europeans arabs americans mexicans",
    "femmes hommes", "musulmans chrétiens juifs", "noirs blancs", "immigrés réfugiés", "frauen männer",
    "muslime christen juden", "schwarze weiße", "einwanderer flüchtlinge", "mujeres hombres",
    "musulmanes cristianos judíos", "negros blancos", "inmigrantes refugiados",
)


def swaps(groups: tuple[str, ...] = GROUPS) -> dict[str, str]:
    """Each group name and the next one of its line."""
    return {a: b for line in map(str.split, groups) for a, b in zip(line, line[1:] + line[:1], strict=True)}


def feature_hashes(words: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and their beginnings, and the text each belongs to."""
    values, docs = [words.hash], [words.doc]
    up, down = textvec.powers(len(words.data) + 1)
    total = np.zeros(len(words.data) + 1, np.uint64)
    np.cumsum(textvec._BYTE[words.data] * up[: len(words.data)], out=total[1:])
    size = words.end - words.start
    for k in PREFIXES:
        long = size > k
        s = words.start[long]
        values.append(textvec.mix((total[s + k] - total[s]) * down[s] + np.uint64(1000 + k) * textvec._MULT))
        docs.append(words.doc[long])
    return np.concatenate(values), np.concatenate(docs)


def text_features(column: pa.Array):
    """(first text, number of texts, hashes, texts) for runs of a column."""
    data, offsets = textvec.text_buffer(column)
    for i, j in textvec.chunks(offsets):
        with np.errstate(over="ignore"):
            yield i, j - i, *feature_hashes(textvec.Words(data, offsets[i : j + 1]))


@dataclass
class Model:
    """hashes (sorted), their weights, and the bias of a text without any of them.

    ``pairs`` counts the rewritten sentences of the fit, ``changed`` those with a change in any feature of the model.
    """

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    pairs: int = 0
    changed: int = 0

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    def columns(self, values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, column) of the features that the model has."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.flatnonzero(self.maybe[values >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, values[near]), len(self.hashes) - 1)
        hit = self.hashes[at] == values[near]
        both = np.unique(docs[near][hit] * np.int64(len(self.hashes)) + at[hit])
        return both // len(self.hashes), both % len(self.hashes)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for i, n, values, docs in text_features(column):
            row, col = self.columns(values, docs)
            z = self.bias + np.bincount(row, self.weights[col], n)
            out[i : i + n] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out


def train(x: np.ndarray, y: np.ndarray, change: np.ndarray, l2=L2, counterfactual=COUNTERFACTUAL, steps=STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias minimising log loss + l2 |w|^2 / 2 + counterfactual * w^T change w / 2.

    ``change`` is the mean of c c^T over the changes c of the features in rewritten sentences.
    Accelerated gradient descent with a step from the largest curvature; classes weigh the same.
    """
    n, k = x.shape
    if not n or not k or y.min() == y.max():
        return np.zeros(k), 0.0
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    x1 = np.concatenate([x, np.ones((n, 1), x.dtype)], axis=1)
    penalty = np.zeros((k + 1, k + 1))
    penalty[:k, :k] = counterfactual * change
    v = np.ones(k + 1) / np.sqrt(k + 1)
    for _ in range(12):  # power iteration for a bound of the curvature
        v = x1.T @ (weight * (x1 @ v)) / 4 + penalty @ v + l2 * v
        top = np.linalg.norm(v)
        v /= top
    w = look = np.zeros(k + 1)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ look, -500, 500)))
        grad = x1.T @ (weight * (p - y)) + penalty @ look
        grad[:k] += l2 * look[:k]
        step = look - grad / (1.1 * top)
        look = step + t / (t + 3) * (step - w)
        w = step
    return w[:k], float(w[k])


def rewritten(text: str, groups: tuple[str, ...] = GROUPS) -> Iterator[tuple[str, str]]:
    """Every sentence of a text as a pair that differs in the names of groups only.

    A sentence that names groups stands beside itself with the names exchanged; into any other one
    two names of one line are put in turn, line and place going by a checksum of the sentence.
    """
    table, lines = swaps(groups), [line.split() for line in groups if len(line.split()) > 1]
    word = re.compile(r"[^\W\d_]+")
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        words = sentence.split()
        if not words:
            continue
        other = word.sub(lambda m: table.get(m[0], m[0]), sentence)
        if other != sentence:
            yield sentence, other
        elif lines:
            seed = zlib.crc32(sentence.encode())
            names, at = lines[seed % len(lines)], seed // len(lines) % (len(words) + 1)
            turn = seed // len(lines) % len(names)
            first, second = names[turn], names[(turn + 1) % len(names)]
            yield tuple(" ".join([*words[:at], name, *words[at:]]) for name in (first, second))


def _changes(draft: Model, groups: tuple[str, ...]):
    """mapInArrow: (text, ...) -> (i, j, x): sums of products of the changes of features i and j; i = -1 counts
    all pairs (j = 0) and those with a change (j = 1)."""

    def run(batches):
        k = len(draft.hashes)
        total, count, changed = np.zeros((k, k)), 0, 0

        def flush(pairs):
            nonlocal total, count, changed
            change = np.zeros((len(pairs), k), np.float32)
            for side, sign in ((0, 1), (1, -1)):
                for i, _, values, docs in text_features(pa.array([p[side] for p in pairs], pa.string())):
                    row, col = draft.columns(values, docs)
                    change[row + i, col] += sign
            some = change.any(axis=1)
            count, changed = count + len(pairs), changed + int(some.sum())
            total += (change[some].T @ change[some]).astype(np.float64)

        for batch in batches:
            pairs, size = [], 0
            for text in batch.column(0).to_pylist():
                for pair in rewritten(text or "", groups):
                    pairs.append(pair)
                    size += len(pair[0])
                    if len(pairs) >= 4096 or size >= 1 << 20:
                        flush(pairs)
                        pairs, size = [], 0
            if pairs:
                flush(pairs)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, [-1, -1]).astype(np.int32)), pa.array(np.append(j, [0, 1]).astype(np.int32)), pa.array(np.append(total[i, j], [count, changed]).astype(np.float64))],
            names=["i", "j", "x"],
        )

    return run


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE,
        features: int = FEATURES, counterfactual: float = COUNTERFACTUAL, groups: tuple[str, ...] = GROUPS) -> Model:
    """Fits the classifier on at most ``sample`` labelled texts of each class (in order of a hash of the key), repeated keys or not.

    ``groups`` holds lines of names that can stand for one another; every sentence of the sample is
    rewritten with them, and ``counterfactual`` weighs the penalty on the change of the score.

    ``labels`` holds (key, label) of the rows to learn from; labels other than 0 and 1 and null
    keys are passed over.  Without rows of both classes every score is the share of label 1 (0.5
    without any).
    """
    scratch.prepare(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    share = known.agg(F.avg("y").alias("p")).first()["p"]
    part = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample)
    chosen = F.broadcast(part(0).unionByName(part(1)))  # 2 * sample rows at most
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(chosen, "k").withColumn("row", F.monotonically_increasing_id())
    texts = scratch.keep(texts, "labelled")
    # Keys may repeat, in labels or in docs: of the rows that these keys have, so many again.
    order = [F.xxhash64("k"), F.col("k"), F.xxhash64("text"), F.col("row")]
    first = [texts.where(F.col("y") == y).select("row", *[c.alias(f"o{i}") for i, c in enumerate(order)]).orderBy("o0", "o1", "o2", "o3").limit(sample).select("row") for y in (0, 1)]
    texts = scratch.keep(texts.join(F.broadcast(first[0].unionByName(first[1])), "row", "left_semi").select("text", "y"), "sampled")
    size = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        share = 0.5 if share is None else share
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))

    def count(batches):
        for batch in batches:
            y = batch.column(1).to_numpy()
            for i, n, values, rows in text_features(batch.column(0)):
                both = np.lexsort((values, rows))
                values, rows = values[both], rows[both]
                first = np.concatenate([[True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])]) if len(values) else np.zeros(0, bool)
                values, own = values[first], y[i : i + n][rows[first]]
                kinds, at = np.unique(values, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds.view(np.int64)), pa.array(np.bincount(at, own, len(kinds)).astype(np.int64)), pa.array(np.bincount(at, 1 - own, len(kinds)).astype(np.int64))],
                    names=["h", "pos", "neg"],
                )

    counts = texts.mapInArrow(count, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # Likelihood ratio of one rate for each class against one rate for both.
    fits = lambda k, n, p: k * F.log(F.greatest(p, F.lit(1e-9))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-9)))
    pos, neg, both = F.col("pos"), F.col("neg"), (F.col("pos") + F.col("neg")) / (size[0] + size[1])
    gain = fits(pos, size[1], pos / size[1]) + fits(neg, size[0], neg / size[0]) - fits(pos, size[1], both) - fits(neg, size[0], both)
    told = counts.withColumn("gain", gain).where((F.col("pos") + F.col("neg") >= LEAST_TEXTS) & (F.col("gain") >= LEAST_GAIN))
    top = told.orderBy(F.desc("gain"), "h").limit(features).select("h").collect()
    draft = Model(np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64)), np.zeros(len(top)), 0.0)

    def rows(batches):
        for batch in batches:
            y = batch.column(1).to_pylist()
            for i, n, values, docs in text_features(batch.column(0)):
                row, col = draft.columns(values, docs)
                cut = np.searchsorted(row, np.arange(n + 1))
                cols = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(col, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(y[i : i + n], pa.int32()), cols], names=["y", "cols"])

    found = texts.mapInArrow(rows, "y int, cols array<int>").collect()  # 2 * sample rows at most
    sums = texts.mapInArrow(_changes(draft, groups), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    change, seen = np.zeros((len(top), len(top))), {0: 0, 1: 0}
    for r in sums.collect():  # features ** 2 rows at most
        if r["i"] < 0:
            seen[r["j"]] = int(r["x"])
        else:
            change[r["i"], r["j"]] = r["x"]
    x = _dense([r["cols"] for r in found], len(top))
    weights, bias = train(x, np.array([r["y"] for r in found]), change / max(seen[0], 1), counterfactual=counterfactual)
    # The classes weighed the same in the fit.
    bias += SHARE * float(np.log(share / (1 - share)))
    return Model(draft.hashes, weights, bias, seen[0], seen[1])


def _dense(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.float32)
    for i, cols in enumerate(lists):
        out[i, cols] = 1
    return out


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row; null and empty texts get the score of a text without features."""
    scratch.prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], names=["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def reject(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``limit``, unchanged.

    Defined cases: null and empty texts have the score of a text without features; repeated rows
    are judged alike and all stay or go; all columns pass through whatever their names; an empty
    table gives an empty one.
    """
    scratch.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) < limit))

    return docs.mapInArrow(run, docs.schema)


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo 5."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(fold("doc_id") != 0))
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
