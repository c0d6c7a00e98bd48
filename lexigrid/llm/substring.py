"""Exact removal of long repeated word spans through a compacted de Bruijn graph.

A window is ``span`` consecutive words. A word goes if a window over it also starts in a document with
a smaller doc_id. Of the k-mers of words only those are nodes of the graph that are the minimum of some run of
``span - k + 1`` k-mers, so every window holds at least one, the same in every copy ("anchor", about 5 % of the
positions). The windows of which an anchor is the minimum follow one another; the words under them are an edge.

* A node seen in one document only has no repeated window.
* A node with one edge does not branch: all its windows repeat together, and the smallest doc_id keeps them. Where an
  edge is followed by the same one wherever it occurs, and that one occurs as often, the two are one path. Joins
  compact such paths, doubling their length each round, and documents meet whole paths by their first edge.
* A node with several edges branches. The occurrence with the smallest doc_id of each edge has its windows looked
  up one by one, at its coordinates in the source text.

Windows and edges are verified by their words: what is compared is a 128-bit BLAKE2b digest of the words'
bytes, read at the coordinates in the source text. The hashes of k-mers only choose anchors: if two k-mers
share one, their node branches, and its windows are looked up. Counts are combined before each shuffle and
joins may be split, so a passage in a third of all documents makes no hot task.

Null texts have no words. A null doc_id is larger than any other. Rows that share a doc_id, or have none, are
neither smaller nor larger than one another, and are told apart by 128 bits of hashes of their texts; equal
rows get equal results. Very long words and texts are handled whole, further columns go along unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import stored, table
from ._text import chunks, span_hash, word_hashes, words

SPAN = 50
KMER = 10


def anchors(h: np.ndarray, bounds: np.ndarray, span: int, k: int) -> tuple[np.ndarray, ...]:
    """For word hashes of documents (bounds: first words): document, k-mer hash, and first and last window
    start of each anchor with its windows. Of equal minima the rightmost is taken.
    """
    n, lengths = len(h), np.diff(bounds)
    if not (lengths >= span).any():
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    at = np.arange(n - k + 1)
    kmers = span_hash(h, at, at + k)
    w = span - k + 1
    doc = np.repeat(np.arange(len(lengths)), lengths)
    # Minima of w k-mers by doubling; a hash and its distance from the right are one number.
    low = np.uint64((1 << 24) - 1)
    own = (at - bounds[doc[: len(at)]]).astype(np.uint64) & low
    best, reach = (kmers & ~low) | (low - own), 1
    while reach * 2 <= w:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < w:
        best = np.minimum(best[: len(best) - (w - reach)], best[w - reach :])
    # best[p] is the minimum over the k-mers at p..p+w-1, those of the window of words p..p+span-1.
    p = np.flatnonzero(doc[: len(best)] == doc[span - 1 : span - 1 + len(best)])
    place = p + (((low - (best[p] & low)).astype(np.int64) - (p - bounds[doc[p]])) & int(low))
    new = np.r_[True, (place[1:] != place[:-1]) | (doc[p[1:]] != doc[p[:-1]])]
    first = p[new]
    last = p[np.r_[new[1:], True]]
    return doc[first], kmers[place[new]], first, last


_ROW = ["d", "t", "u"]


def _doc_key() -> list[Column]:
    """doc_id with null as the largest, and two hashes that tell rows of one doc_id apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text", "doc_id").alias("t"), F.xxhash64(F.lit(1), "text").alias("u")]


class Digests:
    """128-bit digests of runs of words, joined by single spaces, as two columns of longs."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        lengths = ends - starts
        self.at = np.concatenate([[0], np.cumsum(lengths + 1)])
        packed = np.full(int(self.at[-1]), 32, np.uint8)
        inside = np.ones(len(packed), bool)
        inside[self.at[1:] - 1] = False
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts] += 1
        edge[ends] -= 1
        packed[inside] = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
        self.packed = memoryview(packed)

    def of(self, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blake, packed = hashlib.blake2b, self.packed
        raw = b"".join([blake(packed[i:j], digest_size=16).digest() for i, j in zip(self.at[first].tolist(), (self.at[after] - 1).tolist(), strict=True)])
        both = np.frombuffer(raw, np.int64).reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


_ANCHOR = "d long, t long, u long, first int, last int, kmer long, path1 long, path2 long, next1 long, next2 long"


def _find(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                starts, ends, bounds = words(data, offsets)
                h = word_hashes(data, starts, ends)
                doc, kmers, first, last = anchors(h, bounds, span, k)
                if not len(doc):
                    continue
                p1, p2 = Digests(data, starts, ends).of(first, last + span)
                # Where a text repeats itself, anchors with the same path follow one another: they are one row.
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1) | (kmers[1:] != kmers[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
                last = last[np.r_[new[1:], True]]
                doc, first, kmers, p1, p2 = (x[new] for x in (doc, first, kmers, p1, p2))
                # The edge that follows without a gap.
                ends = np.ones(len(doc), bool)
                ends[:-1] = (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)
                n1, n2 = (pa.array(np.roll(x, -1), mask=ends) for x in (p1, p2))
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).take(rows) for i in range(3)]
                    + [pa.array((x - bounds[doc]).astype(np.int32)) for x in (first, last)]
                    + [*map(pa.array, (kmers.view(np.int64), p1, p2)), n1, n2],
                    names=[x.split()[0] for x in _ANCHOR.split(", ")],
                )

    return run


_WINDOW = "d long, t long, u long, p int, w1 long, w2 long"


def _look_up(span: int):
    """Digests of the windows asked for in ``asked`` (array of first and last starts in turn)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                starts, ends, bounds = words(data, offsets)
                docs, places = [], []
                for i, asked in enumerate(part.column(4)):
                    pairs = np.asarray(asked.values, np.int64).reshape(-1, 2)
                    own = np.concatenate([np.arange(a, b + 1) for a, b in pairs])
                    docs.append(np.full(len(own), i))
                    places.append(own)
                doc, p = np.concatenate(docs), np.concatenate(places)
                at = p + bounds[doc]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).take(rows) for i in range(3)] + [pa.array(p.astype(np.int32)), *map(pa.array, Digests(data, starts, ends).of(at, at + span))],
                    names=[x.split()[0] for x in _WINDOW.split(", ")],
                )

    return run


def compacted(edges: DataFrame) -> DataFrame:
    """(path1, path2, windows) of first edges of paths and of edges outside of paths, from edges (path1, path2, n, least
    and most windows w0 and w1, least and greatest successor s0 and s1, successors): a path's windows are all its edges'."""
    plain = edges.where("w0 = w1")
    ahead = plain.where("successors = n AND s0 = s1").select("path1", "path2", "n", "w0", F.col("s0.next1").alias("f1"), F.col("s0.next2").alias("f2"))
    behind = plain.select(F.col("path1").alias("f1"), F.col("path2").alias("f2"), F.col("n").alias("m"), F.col("w0").alias("w"))
    links = stored(ahead.join(behind, ["f1", "f2"]).where("n = m"), "path-links")
    start = links.select("path1", "path2", "f1", "f2", F.col("w0").cast("long").alias("windows"))
    last = links.select(F.col("f1").alias("path1"), F.col("f2").alias("path2"), F.col("w").cast("long").alias("windows")).join(links, ["path1", "path2"], "left_anti")
    steps = stored(start.unionByName(last.withColumns({"f1": F.lit(None).cast("long"), "f2": F.lit(None).cast("long")})), "path-steps")
    while not steps.where("f1 IS NOT NULL").isEmpty():
        on = steps.select(F.col("path1").alias("f1"), F.col("path2").alias("f2"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("windows").alias("more"))
        longer = steps.where("f1 IS NOT NULL").join(on, ["f1", "f2"]).select("path1", "path2", F.col("g1").alias("f1"), F.col("g2").alias("f2"), (F.col("windows") + F.col("more")).alias("windows"))
        steps = stored(longer.unionByName(steps.where("f1 IS NULL")), "path-steps")
    inner = links.select(F.col("f1").alias("path1"), F.col("f2").alias("path2"))
    paths = steps.select("path1", "path2", "windows")
    return edges.select("path1", "path2").join(inner, ["path1", "path2"], "left_anti").join(paths, ["path1", "path2"], "left")


def repeated_spans(docs: DataFrame, span: int = SPAN, k: int = KMER) -> DataFrame:
    """(d, t, u, spans): for each row with repeated windows, pairs of first and last window start, in no order."""
    key = _doc_key()
    found = stored(docs.select(*key, "text").mapInArrow(_find(span, k), _ANCHOR), "anchors")
    # Aggregates are stored before they are joined, so that both sides of a join are plain shuffles, which may be split.
    shared = stored(found.groupBy("kmer").agg(F.min("d").alias("a"), F.max("d").alias("z")).where("a < z").select("kmer"), "kmers-shared")
    found = stored(found.join(shared, "kmer", "left_semi"), "anchors-shared")
    edge, width = ["kmer", "path1", "path2"], F.col("last") - F.col("first") + 1
    after = F.when(F.col("next1").isNotNull(), F.struct("next1", "next2"))
    edges = found.groupBy(*edge).agg(
        F.min("d").alias("least"), F.count("*").alias("n"), F.min(width).alias("w0"), F.max(width).alias("w1"), F.min(after).alias("s0"), F.max(after).alias("s1"), F.count("next1").alias("successors")
    )
    edges = stored(edges, "edges")
    degrees = stored(edges.groupBy("kmer").agg(F.count("*").alias("branches")), "degrees")
    edges = stored(edges.join(degrees, "kmer"), "edges-with-degrees")
    first = stored(compacted(edges.where("branches = 1")), "paths")
    straight = edges.where("branches = 1").join(first, ["path1", "path2"]).select(*edge, "least", "branches", "windows")
    branching = edges.where("branches > 1").select(*edge, "least", "branches", F.lit(None).cast("long").alias("windows"))
    met = found.join(straight.unionByName(branching), edge)
    last = F.coalesce(F.col("first") + F.col("windows").cast("int") - 1, F.col("last"))
    found = stored(met.select(*_ROW, "first", last.alias("last"), "least", "branches"), "paths-met")
    whole = found.where("least < d").select(*_ROW, "first", "last")
    asked = found.where("least = d AND branches > 1").groupBy(*_ROW).agg(F.flatten(F.collect_set(F.array("first", "last"))).alias("asked"))
    sources = docs.select(*key, "text").join(asked, _ROW)
    windows = stored(sources.select(*_ROW, "text", "asked").mapInArrow(_look_up(span), _WINDOW), "windows")
    least = stored(windows.groupBy("w1", "w2").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").select("w1", "w2", "least"), "windows-shared")
    single = windows.join(least, ["w1", "w2"]).where("least < d").select(*_ROW, F.col("p").alias("first"), F.col("p").alias("last"))
    return whole.unionAll(single).groupBy(*_ROW).agg(F.flatten(F.collect_set(F.array("first", "last"))).alias("spans"))


def covered(n: int, spans: np.ndarray, span: int) -> np.ndarray:
    """Which of n words some window with a start in the given pairs covers."""
    edge = np.zeros(n + 1, np.int32)
    pairs = np.asarray(spans, np.int64).reshape(-1, 2)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1] + span, -1)
    return np.cumsum(edge[:n]) > 0


def _cut(span: int, names: list[str], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                text, spans = part.column(part.num_columns - 2), part.column(part.num_columns - 1)
                total, gone, out = [], [], []
                for x, s in zip(text, spans, strict=True):
                    own = (x.as_py() or "").encode("utf-8", "surrogatepass").split() if digest or s.is_valid else []
                    kept = own
                    if s.is_valid:
                        lost = covered(len(own), s.values.to_numpy(zero_copy_only=False), span)
                        kept = [w for w, g in zip(own, lost.tolist(), strict=True) if not g]
                    total.append(len(own))
                    gone.append(len(own) - len(kept))
                    if digest:
                        out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    else:
                        out.append(b" ".join(kept).decode("utf-8", "surrogatepass") if len(kept) < len(own) else x.as_py())
                cols = part.columns[:-2]
                if digest:
                    cols += [pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string())], names=names)

    return run


def _with_spans(docs: DataFrame, columns: list[Column], span: int, k: int) -> DataFrame:
    names = {c: f"_lexigrid_{c}" for c in [*_ROW, "spans"]}
    keys = [names[c] for c in _ROW]
    spans = repeated_spans(docs, span, k).withColumnsRenamed(names)
    return docs.withColumns(dict(zip(keys, _doc_key(), strict=True))).join(spans, keys, "left").select(*columns, F.col("text").alias("_lexigrid_text"), names["spans"])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return _with_spans(docs, [F.col("doc_id").cast("long").alias("doc_id")], SPAN, KMER).mapInArrow(_cut(SPAN, names, True), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, span: int = SPAN, k: int = KMER) -> DataFrame:
    """``docs`` with repeated spans cut from ``text``; a text that loses words is its kept words joined by
    one space, any other is unchanged. Columns and rows stay; n_chars, if there, follows the text."""
    others = [c for c in docs.columns if c != "text"]
    out = _with_spans(docs, [F.col(c) for c in others], span, k)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*others, "text"])
    out = out.mapInArrow(_cut(span, [*others, "text"], False), schema)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(types["n_chars"]))
    return out.select(*docs.columns)


OP8_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM docs),
windows AS (SELECT doc_id, j, CASE WHEN j + 49 <= len(ws) THEN array_to_string(ws[j:j + 49], ' ') END AS w, ws[j] AS word FROM words),
least AS (SELECT w, min(doc_id) AS first FROM windows WHERE w IS NOT NULL GROUP BY w),
flagged AS (
    SELECT doc_id, j, word,
        max(CASE WHEN first < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
    FROM windows LEFT JOIN least USING (w)),
cut AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone = 0) AS kept FROM flagged GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""
