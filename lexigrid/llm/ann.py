"""Approximate nearest neighbours in balanced posting lists.

Centroids are learned by k-means on a bounded sample of vectors and joined by a neighbour graph, which is
searched in memory, many vectors at a time (best first, a beam of the nearest found). Every vector is
posted to the list of its nearest centroid, and as a boundary vector to others that are about as near. A query reads the lists whose distance is within a ratio of
the nearest. Lists above a size are kept in parts by a hash of the row, and each part sees the queries of
its list, in blocks of bounded size, so lists stay balanced and a vector in a third of all rows makes no hot task.
A query that finds fewer than it asks for in the lists it read reads all lists.

Distances to what the lists hold are exact, in double precision on the original vectors. Recall is
measured against brute force in the tests.

Vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of another
length than most. A null vec_id takes part in nothing. Rows are told apart by a number that they get when they are
stored: of rows with equal vec_id, or equal altogether, each is a candidate and a query of its own, and a query
leaves out its own row alone. Ties go to the smaller vec_id. Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._io import stored, table

#: Vectors that centroids are learned from, and vectors a list should hold, at most so many lists.
SAMPLE, LIST, MOST_LISTS = 20_000, 200, 4096
#: Largest part of a list, and most queries that a part meets at a time.
PART, BLOCK = 2_000, 2_000
#: Lists of one vector, how much farther a list's centroid may be than the nearest to post to it and to search it.
COPIES, POST_RATIO, SEARCH_RATIO = 4, 1.15, 1.13
#: Lists that a query reads at least, however near one centroid is.
LEAST_LISTS = 16
LINKS, BEAM = 16, 96
TOP = 10


@dataclass
class Index:
    centroids: np.ndarray
    links: np.ndarray

    def nearest(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Centroids found near each row of x by searching the graph, nearest first, and squared distances."""
        n, c = len(x), len(self.centroids)
        beam = min(beam, c)
        norm = (self.centroids**2).sum(1)
        own = (x**2).sum(1)[:, None]
        starts = np.unique(np.linspace(0, c - 1, min(c, beam)).astype(np.int64))
        ids = np.repeat(starts[None], n, 0)
        d = own + norm[ids] - 2 * x @ self.centroids[starts].T
        seen = np.zeros((n, c), bool)
        seen[:, starts] = True
        done = np.zeros((n, c), bool)
        rows = np.arange(n)
        for _ in range(4 * beam):
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
            fresh = ~done[rows[:, None], ids] & np.isfinite(d)
            live = fresh.any(1)
            if not live.any():
                break
            pick = ids[rows, fresh.argmax(1)]
            done[rows[live], pick[live]] = True
            near = self.links[pick]
            new = ~seen[rows[:, None], near] & live[:, None]
            seen[rows[:, None], near] = True
            far = own + norm[near] - 2 * np.einsum("nd,nkd->nk", x, self.centroids[near])
            ids, d = np.concatenate([ids, near], 1), np.concatenate([d, np.where(new, far, np.inf)], 1)
        return ids, np.maximum(d, 0)


def learn(x: np.ndarray, lists: int, seed: int = 3, rounds: int = 8) -> Index:
    """K-means centroids of a sample and the graph of their neighbours."""
    rng = np.random.default_rng(seed)
    c = np.unique(x[rng.permutation(len(x))[: min(lists, len(x))]], axis=0)
    for _ in range(rounds):
        at = np.concatenate([((c**2).sum(1) - 2 * p @ c.T).argmin(1) for p in np.array_split(x, max(1, len(x) // 2048))])
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        # Empty centroids take the place of members of the largest.
        for e in np.flatnonzero(n == 0):
            big = np.flatnonzero(at == n.argmax())
            c[e] = x[rng.choice(big)]
    k = min(LINKS, len(c))
    links = np.concatenate([((p**2).sum(1)[:, None] + (c**2).sum(1) - 2 * p @ c.T).argsort(1)[:, :k] for p in np.array_split(c, max(1, len(c) // 512))])
    far = rng.integers(0, len(c), (len(c), 2))  # a few long links keep the graph in one piece
    return Index(c, np.concatenate([links, far], 1))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<float> or array<double>) of the rows that take part, all of one length."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole & F.exists("v", lambda x: x != 0))
    length = v.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return v.where(F.size("v") == (length["length"] if length else 0))


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = pa.chunked_array([col] if isinstance(col, pa.Array) else col.chunks, type=col.type)
    n = len(flat)
    return np.concatenate([np.asarray(c.flatten(), np.float64) for c in flat.chunks]).reshape(n, -1) if n else np.zeros((0, 0))


def search(vectors: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row where ``is_query``: its nearest rows by Euclidean distance."""
    spark = vectors.sparkSession
    base = stored(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
    n, kind = base.count(), base.schema["v"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).select("v").toArrow()
    index = spark.sparkContext.broadcast(learn(_matrix(sample.column("v")), max(1, min(MOST_LISTS, n // LIST))))  # at most MOST_LISTS centroids

    def to_lists(part: pa.RecordBatch, ids: np.ndarray, row: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(ids[row, k].astype(np.int32)), *[c.take(at) for c in part.columns]], names=["list", "vec_id", "v", "row"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids, d = found.nearest(_matrix(part.column(1)), 32)
                d = np.sqrt(d)
                near = d[:, :COPIES] <= POST_RATIO * d[:, :1]
                near[:, 0] = True
                yield to_lists(part, ids, *np.nonzero(near & np.isfinite(d[:, :COPIES])))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids, d = found.nearest(_matrix(part.column(1)))
                near = (np.sqrt(d) <= SEARCH_RATIO * np.sqrt(d[:, :1])) | (np.arange(d.shape[1]) < LEAST_LISTS)
                yield to_lists(part, ids, *np.nonzero(near & np.isfinite(d)))

    schema = f"list int, vec_id long, v {kind}, row long"
    posted = stored(base.select("vec_id", "v", "row").mapInArrow(post, schema), "ann-lists")
    parts = stored(posted.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "ann-parts")  # a row for each of at most MOST_LISTS lists
    posted = posted.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    queries = base.where(is_query).select("vec_id", "v", "row")

    def found_in(asked: DataFrame) -> DataFrame:
        """(query_row, query_id, row, vec_id, score): of each part that a query (list, vec_id, v, row) meets its nearest rows."""
        blocks = F.broadcast(stored(asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "ann-blocks"))
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = asked.join(blocks, "list").join(F.broadcast(parts), "list")
        left = left.select("list", each("parts").alias("part"), F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), "row", "vec_id", "v")
        right = posted.join(blocks, "list").select("list", "part", each("blocks").alias("block"), "row", "vec_id", "v")
        key = ["list", "part", "block"]
        hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "query_row long, query_id long, row long, vec_id long, score double")
        return hits.dropDuplicates(["query_row", "row"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        x, ids, rows = _matrix(right.column("v")), right.column("vec_id").to_numpy(), right.column("row").to_numpy()
        out = []
        if len(ids) and left.num_rows:
            q = _matrix(left.column("v"))
            for i, (own, name) in enumerate(zip(left.column("row").to_pylist(), left.column("vec_id").to_pylist(), strict=True)):
                d = np.sqrt(((x - q[i]) ** 2).sum(1))
                d[rows == own] = np.inf
                # Whatever is as near as the last one kept stays until ties are settled.
                near = np.flatnonzero(d <= np.partition(d, top - 1)[top - 1]) if len(d) > top else np.arange(len(d))
                near = near[np.isfinite(d[near])]
                near = near[np.lexsort((rows[near], ids[near], d[near]))][:top]
                out += [(own, name, int(rows[j]), int(ids[j]), float(d[j])) for j in near]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.float64())], names=["query_row", "query_id", "row", "vec_id", "score"])

    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    best = stored(ranked(found_in(queries.mapInArrow(route, schema))), "ann-found")
    enough = best.groupBy("query_row").agg(F.count("*").alias("n")).where(F.col("n") >= min(top, n - 1)).select(F.col("query_row").alias("row"))
    short = stored(queries.join(enough, "row", "left_anti"), "ann-short")
    if not short.isEmpty():
        every = F.explode(F.sequence(F.lit(0), F.lit(len(index.value.centroids) - 1)))
        wide = short.select(every.alias("list"), "vec_id", "v", "row")  # the queries that found too few, in all lists
        best = best.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti").unionByName(ranked(found_in(wide)))
    return best.select("query_id", "rank", "vec_id", "score")


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
