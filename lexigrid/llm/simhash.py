"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``d`` bits agree in at least ``8 - d`` of their eight
bytes, the guaranteed minimum. A posting list per single byte would be read pair by pair by a large part of
the corpus, so a posting key is a choice of one position less than the minimum, with the bytes found there;
by pigeonhole the choices among the first seven positions are enough (35 postings for d = 4). In a list the
shared bytes of each pair are tallied over all eight positions, pairs below the minimum go, and what is
left is verified by its bits.

Lists hold distinct fingerprints only. A task reads them in key order and emits a spanning forest of
each list, never its pairs. Long lists are covered by balls of radius d/2, whose members all link with
one another, so a large group of near copies costs one comparison per ball and member. Lists above
``LIST`` members are dealt out again, under each further byte (a pair above the minimum shares one more)
and, if still too long, under each of d + 1 slices of the remaining bits (one of which is the same), so
no list grows without bound in one task and no pair is lost.

Nulls, empty texts and texts without a word have fingerprint zero. Rows that repeat a doc_id are kept;
a null doc_id takes part and gets the component's smallest id (null if the component has none).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._io import stored, table

SHINGLE = 4
DISTANCE = 4
#: Members of a list that one task compares.
LIST = 4096
#: Fingerprints that a task keeps joined at a time.
_JOINED = 1 << 20
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each shingle, block by block; nothing for a text without a word."""
    packed = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not packed:
        return
    gaps = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(packed)]
    n = max(1, len(starts) - shingle + 1)
    ends = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _BLOCK):
        yield np.array([digest(packed[s:e], 42) for s, e in zip(starts[i : min(n, i + _BLOCK)], ends[i : i + _BLOCK], strict=False)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the numbers have each of the 64 bits set: bytes are added 255 at a time, eight to a word."""
    cuts = np.arange(0, len(h), 255)
    out = np.zeros((8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), cuts)
        out[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return out.ravel()


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text: lower-case A-Z, shingles of words, XXH64 with seed 42, majority of each bit."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle):
        counts += bit_counts(h)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def row_key() -> list:
    """Two columns that tell rows apart by doc_id and text; equal rows share them."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2")]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, k1, k2, fp): the fingerprint of each whole text as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(x.as_py(), shingle) for x in batch.column(3)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps.view(np.int64))], names=["doc_id", "k1", "k2", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text").mapInArrow(run, "doc_id long, k1 long, k2 int, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight bytes of each x = a ^ b are equal in a and b."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1)


def linked(x: np.ndarray, distance: int) -> np.ndarray:
    """Count filter, then verification, of x = a ^ b."""
    return (shared_bytes(x) >= 8 - distance) & (np.bitwise_count(x) <= distance)


class _Sets:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (p := up.setdefault(top, top)) != top:
            top = p
        while x != top:
            up[x], x = top, up[x]
        return top

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def link_list(v: np.ndarray, distance: int, sets: _Sets) -> None:
    """Join in ``sets`` whatever links within one posting list of distinct fingerprints."""
    ids = v.view(np.int64).tolist()
    rest, balls = np.arange(len(v)), []
    while rest.size:
        lead = int(rest[0])
        x = v ^ v[lead]
        for j in np.flatnonzero(linked(x, distance)).tolist():
            sets.join(ids[lead], ids[j])
        near = np.bitwise_count(x[rest]) <= distance // 2
        balls.append((lead, rest[near]))
        rest = rest[~near]
    leads = v[[lead for lead, _ in balls]]
    for a, (lead, own) in enumerate(balls):
        for b in (np.flatnonzero(np.bitwise_count(leads[a + 1 :] ^ v[lead]) <= 2 * distance) + a + 1).tolist():
            if sets.root(ids[lead]) == sets.root(ids[balls[b][0]]):
                continue
            for i in own.tolist():
                hit = np.flatnonzero(linked(v[balls[b][1]] ^ v[i], distance))
                if hit.size:
                    sets.join(ids[i], ids[int(balls[b][1][hit[0]])])
                    break


def _forest(distance: int, most: int | None):
    """From rows (key number, key, fingerprint) in key order to edges (a, b, -1); members of lists above ``most``
    come out as they are (a, null, key number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        key, parts, size = None, [], 0  # the list that may go on in the next batch

        def rows(a: list | np.ndarray, b: list | None, c: int) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array(np.full(n, c, np.int32))], names=["a", "b", "c"])

        def joined() -> Iterator[pa.RecordBatch]:
            pairs = [(x, r) for x in list(sets.up) if (r := sets.root(x)) != x]
            sets.up.clear()
            if pairs:
                yield rows(*map(list, zip(*pairs, strict=True)), -1)

        def whole(v: np.ndarray) -> None:
            if len(v) > 1:
                link_list(v, distance, sets)

        def grow(c: int, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal parts, size
            parts.append(v)
            size += len(v)
            if most is not None and size > most:
                yield rows(np.concatenate(parts).view(np.int64), None, c)
                parts = []

        def close() -> None:
            nonlocal parts, size
            if parts and (most is None or size <= most):
                whole(np.concatenate(parts))
            parts, size = [], 0

        for batch in batches:
            c, m, v = (np.asarray(batch.column(i)) for i in range(3))
            v = v.view(np.uint64)
            if not len(v):
                continue
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (m[1:] != m[:-1])) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(v)]
            last = len(starts) - 1
            if key != (int(c[0]), int(m[0])):
                close()
            two = starts[1:last][ends[1:last] - starts[1:last] == 2]
            two = two[linked(v[two] ^ v[two + 1], distance)]
            for a, b in zip(v[two].view(np.int64).tolist(), v[two + 1].view(np.int64).tolist(), strict=True):
                sets.join(a, b)
            for k in [0, *(np.flatnonzero(ends[1:last] - starts[1:last] > 2) + 1).tolist(), last][: 1 if not last else None]:
                if k:
                    close()
                yield from grow(int(c[starts[k]]), v[starts[k] : ends[k]])
            key = int(c[-1]), int(m[-1])
            if len(sets.up) > _JOINED:
                yield from joined()
        close()
        yield from joined()

    return run


def _keyed(rows: DataFrame, masks: list[int], numbers) -> DataFrame:
    """(c, m, fp): fp under each of the masks whose numbers the column ``numbers`` holds."""
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    posts = rows.select("fp", F.explode(numbers).alias("c"))
    return posts.select("c", F.col("fp").bitwiseAND(F.element_at(signed, F.col("c") + 1)).alias("m"), "fp")


def _lists(posts: DataFrame, distance: int, most: int | None, name: str) -> DataFrame:
    return stored(posts.repartition(F.col("c"), F.col("m")).sortWithinPartitions("c", "m").mapInArrow(_forest(distance, most), "a long, b long, c int"), name)


def links(distinct: DataFrame, distance: int = DISTANCE, most: int | None = None) -> DataFrame:
    """Edges (a, b) that join all fingerprints ``fp``, distinct ones, that differ in at most ``distance`` < 8 bits."""
    least, most = 8 - distance, most or LIST
    taken = max(1, least - 1)
    numbers = lambda found: F.array(*[F.lit(i) for i in found])
    mask = lambda chosen: sum(0xFF << 8 * i for i in chosen)
    some = list(combinations(range(8 - least + taken), taken))
    found = _lists(_keyed(distinct, [mask(x) for x in some], numbers(range(len(some)))), distance, most, "simhash-lists")
    edges, long = [found], found.where("c >= 0")
    every = list(combinations(range(8), least))
    if not long.isEmpty():
        # A pair above the minimum shares one more byte: each list again under every further byte.
        finer = F.array(*[numbers([i for i, x in enumerate(every) if set(s) <= set(x)]) for s in some])
        posts = _keyed(long.select(F.col("a").alias("fp"), F.element_at(finer, F.col("c") + 1).alias("n")).select("fp", F.explode("n").alias("n")).distinct(), [mask(x) for x in every], F.array("n"))
        found = _lists(posts, distance, most, "simhash-long")
        edges.append(found)
        long = found.where("c >= 0")
        if not long.isEmpty():
            # Of distance + 1 slices of the other bits at least one is the same.
            masks = []
            for x in every:
                free = [b for b in range(64) if b // 8 not in x]
                masks += [mask(x) | sum(1 << b for b in free[i :: distance + 1]) for i in range(distance + 1)]
            first = F.col("c") * (distance + 1)
            posts = _keyed(long.select(F.col("a").alias("fp"), F.explode(F.sequence(first, first + distance)).alias("n")), masks, F.array("n"))
            edges.append(_lists(posts, distance, 1 << 62, "simhash-longest"))
    out = edges[0]
    for x in edges[1:]:
        out = out.unionAll(x)
    return out.where("c < 0").select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, k1, k2, fp, root, component_id), one row per input row; root is a fingerprint of the component."""
    fps = stored(fingerprints(docs, shingle), "simhash")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, distance))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = classes.join(ids, "root").select("fp", "root", "component_id")
    return fps.join(by_fp, "fp")


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
