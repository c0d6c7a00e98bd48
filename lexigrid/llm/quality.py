"""Quality scores from random-indexing word vectors and a two-layer network in numpy.

A word stands for two features: its letters in lower case, and its shape (kinds of characters, runs as
one, or that it begins a repeat). Each feature has a sparse random index vector; a feature's word vector is the sum of the index
vectors of the words around it over the learning sample, plus its own. Vectors are pooled per document
by their mean over all words of the whole text. A network of one hidden layer learns the label; its
logit is divided by a temperature that a part of the sample sets.

Learning takes a bounded sample: at most ``SAMPLE`` rows of each label, the first by a hash of doc_id, of
at most ``LONGEST`` bytes each, weighted back to the label counts of all rows that may be learned from.
Every row is scored, over its whole text. Null and empty texts pool to zeros and get a score as well.
Rows without a label in the sample, and labels without a document, are not learned from; where a doc_id
has several labels the smallest counts. Rows are scored one by one, those without a doc_id as well: repeated rows
get equal scores (of six digits, so that a text's place in a batch does not show), and a score of exactly one half is predicted 1. With no or only one label to learn from, every score is the
share of label 1 (0.5 if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._fold import in_fold
from ._io import table
from ._text import chunks, letter_hashes, shape_hashes, span_hash, words

SAMPLE = 2000
LONGEST = 1 << 15
DIM = 32
LETTER_BUCKETS = 1 << 15
SHAPE_BUCKETS = 1 << 12
WINDOW = 2
REPEAT = 3
HIDDEN = 32


@dataclass
class Model:
    letters: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the letters and of the shape of each word, and first words of the documents.

    Where a run of ``REPEAT`` words came before in its document, its first word has the shape of a repeat.
    """
    starts, ends, bounds = words(data, offsets)
    letters = letter_hashes(data, starts, ends)
    a = (letters % np.uint64(LETTER_BUCKETS)).astype(np.int64)
    b = (shape_hashes(data, starts, ends) % np.uint64(SHAPE_BUCKETS - 1)).astype(np.int64) + 1
    if len(a) >= REPEAT:
        at = np.arange(len(a) - REPEAT + 1)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = at[doc[at] == doc[at + REPEAT - 1]]
        runs = span_hash(letters, at, at + REPEAT) + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        again = np.ones(len(at), bool)
        again[np.unique(runs, return_index=True)[1]] = False
        b[at[again]] = 0
    return a, b, bounds


def _index_vectors(n: int, seed: int) -> np.ndarray:
    """Ternary vectors with an eighth of their places set."""
    return np.random.default_rng(seed).choice(np.array([-1, 0, 1], np.float32), (n, DIM), p=[1 / 16, 7 / 8, 1 / 16])


def add_neighbours(total: np.ndarray, ids: np.ndarray, other: np.ndarray, bounds: np.ndarray, index: np.ndarray) -> None:
    """Add to each feature's row in ``total`` the index vectors of the other features around it."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for shift in (s for s in range(-WINDOW, WINDOW + 1) if s):
        at = np.arange(max(0, -shift), len(ids) - max(0, shift))
        at = at[doc[at] == doc[at + shift]]
        seen = index[other[at + shift]]
        for d in range(DIM):
            total[:, d] += np.bincount(ids[at], seen[:, d], len(total))


def word_vectors(total: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The sum of the neighbours' index vectors, at most of an index vector's length, with a feature's own."""
    length = np.linalg.norm(total, axis=1, keepdims=True)
    return (own + total / np.maximum(length, 1) * np.sqrt(DIM / 8)).astype(np.float32)


def pooled(a: np.ndarray, b: np.ndarray, bounds: np.ndarray, letters: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Mean word vectors of each document; zeros if it has no word."""
    n = np.diff(bounds)
    out = np.zeros((len(n), 2 * DIM), np.float32)
    some = n > 0
    if some.any():
        at = bounds[:-1][some]
        out[some, :DIM] = np.add.reduceat(letters[a], at, axis=0) / n[some, None]
        out[some, DIM:] = np.add.reduceat(shapes[b], at, axis=0) / n[some, None]
    return out


def _logits(m: Model, x: np.ndarray) -> np.ndarray:
    h = np.maximum((x - m.mean) / m.scale @ m.w1 + m.b1, 0)
    return (h @ m.w2 + m.b2) / m.temperature


def _log_loss(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return float((w * np.logaddexp(0, np.where(y > 0, -z, z))).sum() / w.sum())


def fit(texts: list[str], y: np.ndarray, w: np.ndarray, seed: int = 7) -> Model:
    """Learn from texts with labels y and row weights w; one row in five sets the temperature."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = [features(data, offsets) for _, data, offsets in chunks(batch, "text", 1 << 20)]
    own_a, own_b = _index_vectors(LETTER_BUCKETS, 1), _index_vectors(SHAPE_BUCKETS, 2)
    total_a, total_b = np.zeros(own_a.shape), np.zeros(own_b.shape)
    for a, b, bounds in parts:
        add_neighbours(total_a, a, b, bounds, own_b)
        add_neighbours(total_b, b, b, bounds, own_b)
    letters, shapes = word_vectors(total_a, own_a), word_vectors(total_b, own_b)
    x = np.concatenate([pooled(*part, letters, shapes) for part in parts])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    m = Model(letters, shapes, x[used].mean(0), x[used].std(0) + 1e-3, rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, 1.0)
    p = {"w1": m.w1, "b1": m.b1, "w2": m.w2, "b2": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    xs, step = (x - m.mean) / m.scale, 0
    for _ in range(60):
        for at in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            pre = xs[at] @ p["w1"] + p["b1"]
            h = np.maximum(pre, 0)
            z = h @ p["w2"] + p["b2"]
            dz = (1 / (1 + np.exp(-z)) - y[at]) * w[at] / w[at].sum()
            dh = np.outer(dz, p["w2"]) * (pre > 0)
            grad = {"w1": xs[at].T @ dh + 1e-4 * p["w1"], "b1": dh.sum(0), "w2": h.T @ dz + 1e-4 * p["w2"], "b2": dz.sum(keepdims=True)}
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = p["w1"], p["b1"], p["w2"], float(p["b2"][0])
    if len(held):
        z = _logits(m, x[held])
        m.temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: _log_loss(z / t, y[held], w[held]))
    return m


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """Model from labelled rows outside the held-out fold, or the share of label 1 where one cannot be learned."""
    good = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in good.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    got = []
    for q in (0, 1):
        # At most ``sample`` ids go to the executors, and as many rows of bounded length come back.
        ids = good.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
        rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").where(F.octet_length("text") <= LONGEST)
        got.append([r["text"] for r in rows.select("doc_id", "text").orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(sample).collect()])
    if not got[0] or not got[1]:
        return len(got[1]) / max(1, len(got[0]) + len(got[1])) if got[0] or got[1] else 0.5
    y = np.r_[np.zeros(len(got[0])), np.ones(len(got[1]))]
    w = np.where(y > 0, counts[1] / len(got[1]), counts[0] / len(got[0]))
    return fit(got[0] + got[1], y, w)


def score(docs: DataFrame, model: Model | float, columns: list[str] | None = None, name: str = "quality_score") -> DataFrame:
    """``columns`` (all by default) of every row of ``docs`` with its score (0 to 1) as ``name``."""
    spark = docs.sparkSession
    if not isinstance(model, Model):
        return docs.select(*(columns or docs.columns), F.lit(float(model)).alias(name))
    shared = spark.sparkContext.broadcast(model)  # fixed size: buckets times dimensions
    names = columns or docs.columns
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, data, offsets in chunks(batch, "_lexigrid_text", 1 << 20):
                a, b, bounds = features(data, offsets)
                z = _logits(m, pooled(a, b, bounds, m.letters, m.shapes))
                s = np.round(1 / (1 + np.exp(-np.clip(z, -60, 60))), 6)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64())], names=[*names, name])

    return docs.select(*names, F.col("text").alias("_lexigrid_text")).mapInArrow(run, schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, ["doc_id"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``."""
    return score(docs, learn(docs, labels), name="_lexigrid_score").where(F.col("_lexigrid_score") >= least).select(*docs.columns)
