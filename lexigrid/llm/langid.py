"""Language of whole texts by a byte convolutional network in numpy.

Bytes are embedded (A-Z as a-z), filters of several widths slide over fixed-length windows of the text, the largest
response of each filter over a window feeds a softmax. Windows follow one another over the whole text
(the last one is filled up with zeros), and a text's distribution is the mean over its windows by length.

Learning takes a bounded sample: at most ``SAMPLE`` documents of each language and about ``TOTAL`` in all (8 of a
language at least), the first by a hash of doc_id and text, drawn in one pass. Of a text of more than ``LONGEST``
characters a piece of that length counts, from a place that the hash chooses; of each, ``WINDOWS`` windows are
drawn. Languages are all non-null values of the rows that may be learned from.
Null texts and texts without a letter are ``und`` with score 0. With nothing to learn from all are. Rows with a null
doc_id are not learned from, but predicted; repeated rows get the same prediction each (scores have six digits, so that
a text's place in a batch does not show); of equally likely languages the first by name counts. Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._fold import in_fold
from ._io import stored, table
from ._text import chunks, folded

SAMPLE, TOTAL = 400, 4000
LONGEST = 1 << 14
WINDOWS = 8
LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
EPOCHS = 12
_LETTER = r"\p{L}"


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # 256 bytes and the filling, by dimension
    filters: np.ndarray  # widest width times dimension, by filter; zeros behind narrower ones
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _shape_mask() -> np.ndarray:
    mask = np.zeros((max(WIDTHS) * EMBED, len(WIDTHS) * FILTERS), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask


def _patches(embed: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Embedded bytes of each place and the places after it: windows, places, widest width times dimension."""
    e = embed[x]
    wide = max(WIDTHS)
    n = x.shape[1] - wide + 1
    return np.concatenate([e[:, i : i + n] for i in range(wide)], axis=2)


def forward(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class probabilities of windows x (byte + 1, 0 fills), the pooled responses and where they came from."""
    p = _patches(m.embed, x)
    r = (p.reshape(-1, p.shape[2]) @ m.filters).reshape(p.shape[0], p.shape[1], -1)
    at = r.argmax(1)
    top = np.take_along_axis(r, at[:, None], 1)[:, 0] + m.bias
    return _softmax(np.maximum(top, 0) @ m.out + m.out_bias), top, at


def probabilities(m: Model, x: np.ndarray) -> np.ndarray:
    p = _patches(m.embed, x)
    top = (p.reshape(-1, p.shape[2]) @ m.filters).reshape(p.shape[0], p.shape[1], -1).max(1) + m.bias
    return _softmax(np.maximum(top, 0) @ m.out + m.out_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over whole documents, the document of each, and its bytes that are not filling."""
    sizes, data = np.diff(offsets), folded(data)
    per = -(-sizes // LENGTH)
    doc = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(LENGTH, sizes[doc] - nth * LENGTH)
    at = (offsets[doc] + nth * LENGTH)[:, None] + np.arange(LENGTH)
    x = np.where(np.arange(LENGTH) < size[:, None], data[np.minimum(at, max(0, len(data) - 1))].astype(np.int16) + 1, 0) if len(data) else np.zeros((0, LENGTH), np.int16)
    return x, doc, size


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    xs, ys = [], []
    for t, lang in zip(texts, langs, strict=True):
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        x, _, _ = windows(raw, np.array([0, len(raw)]))
        if len(x):
            pick = rng.permutation(len(x))[:WINDOWS]
            xs.append(x[pick])
            ys += [names.index(lang)] * len(pick)
    x, y = np.concatenate(xs), np.array(ys)
    weight = (1 / np.bincount(y, minlength=len(names)).clip(1))[y] * len(y) / len(names)
    mask, n = _shape_mask(), len(WIDTHS) * FILTERS
    m = Model(
        names, rng.normal(0, 0.5, (257, EMBED)).astype(np.float32), (rng.normal(0, (1 / EMBED) ** 0.5, mask.shape) * mask).astype(np.float32),
        np.zeros(n, np.float32), rng.normal(0, n**-0.5, (n, len(names))).astype(np.float32), np.zeros(len(names), np.float32),
    )
    m.embed[0] = 0
    params = ["embed", "filters", "bias", "out", "out_bias"]
    first, second = ({k: np.zeros_like(getattr(m, k)) for k in params} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            xb, wb = x[at], weight[at, None] / len(at)
            q, top, place = forward(m, xb)
            dz = q.copy()
            dz[np.arange(len(at)), y[at]] -= 1
            dz *= wb
            h = np.maximum(top, 0)
            dt = (dz @ m.out.T) * (top > 0)
            # The gradient of the maximum goes to the place that gave it.
            b, f = np.nonzero(dt)
            g, start = dt[b, f], place[b, f]
            grads = {k: np.zeros_like(getattr(m, k)) for k in params}
            grads["out"], grads["out_bias"], grads["bias"] = h.T @ dz, dz.sum(0), dt.sum(0)
            for j in range(max(WIDTHS)):
                byte = xb[b, start + j]
                rows = slice(j * EMBED, (j + 1) * EMBED)
                np.add.at(grads["filters"].T, (f, rows), g[:, None] * m.embed[byte])
                np.add.at(grads["embed"], byte, g[:, None] * m.filters[rows, f].T)
            grads["filters"] *= mask
            grads["embed"][0] = 0
            step += 1
            for k in params:
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.002 * (grads[k] ** 2 - second[k])
                getattr(m, k)[...] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.998**step)) + 1e-8)
    return m


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model from (text, lang) of rows outside the held-out fold; None if there are none."""
    good = docs.where(~in_fold() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(_LETTER))
    counts = stored(good.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    sample = max(8, min(sample, TOTAL // max(1, counts.count())))
    h = F.xxhash64("doc_id", "text")
    start = F.pmod(h, F.greatest(F.lit(1), F.length("text") - LONGEST)).cast("int") + 1
    piece = F.when(F.length("text") > LONGEST, F.substring(F.col("text"), start, F.lit(LONGEST))).otherwise(F.col("text"))
    # A hash decides who may be drawn, so that few rows are sorted: four times the sample, or all of a small language.
    drawn = good.join(counts, "lang").where(F.pmod(h, F.lit(1 << 20)) < F.least(F.lit(1.0), 4.0 * sample / F.col("n")) * (1 << 20))
    order = Window.partitionBy("lang").orderBy("h", "text")
    some = drawn.select("lang", piece.alias("text"), F.xxhash64("text", "doc_id").alias("h")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample)
    got = some.orderBy("lang", "r").select("lang", "text").collect()  # at most ``sample`` pieces of bounded length a language
    return fit([r["text"] for r in got], [r["lang"] for r in got]) if got else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size but for a column a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", 256 << 10):
                n = part.num_rows
                lang, score = ["und"] * n, np.zeros(n)
                if m is not None:
                    total = np.zeros((n, len(m.languages)))
                    x, doc, size = windows(data, offsets)
                    for i in range(0, len(x), 256):
                        q = probabilities(m, x[i : i + 256]) * size[i : i + 256, None]
                        np.add.at(total, doc[i : i + 256], q)
                    best = total.argmax(1)
                    mass = total.sum(1)
                    for i, ok in enumerate(part.column(2).to_pylist()):
                        if ok and mass[i] > 0:
                            lang[i], score[i] = m.languages[best[i]], total[i, best[i]] / mass[i]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(np.round(score.clip(0, 1), 6))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(_LETTER), F.lit(False)).alias("letter")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", in_fold().alias("held_out"), "lang_pred", "score")
