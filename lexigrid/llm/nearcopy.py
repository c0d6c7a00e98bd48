"""Near copies: what ``simhash`` links, and what reaches a Jaccard similarity of word shingles.

First comes the operator of ``simhash``, whole and exact: 64-bit fingerprints that differ in four bits or fewer, by
its inverted index, count filter and verification. What it links are near copies. A search for texts further apart follows.

Texts that share four fifths of their shingles differ in about 15 % of the bits of a fingerprint, so no
number of equal bytes is guaranteed among 64 bits. The index therefore posts 256-bit fingerprints, byte
by position: a posting key is a choice of ``KEY_BYTES`` of the 32 positions with the bytes found there, for
``TABLES`` fixed choices. Each is posted a second time with its least decided bit turned over, the bit
that a small change of the text turns most easily. Of pairs at a similarity of 0.80 to 0.83, 96 to 98 %
meet in a list and are within reach (measured on 1000 cut and 1000 edited texts of 45 to 400 words; a test
holds it above 0.9), at 0.83 to 0.87 99 to 99.6 %. What is within reach is verified on the shingles of the
whole texts. The bits of texts of few shingles vary more; those texts are paired exactly, by their rarest
shingles.

All pairs of a large group would grow with its square, so lists give nearest partners by 128 bits: each member with
its nearest, in long lists with the lead that covers it. What those link are groups. Then the lists are read again by
all 256 bits, among the texts that found a partner or had several to choose from, and name the groups of which a
member is within reach of another group's. Texts of these groups are joined exactly, by their rarest shingles, in lists
of more than one group, which give a forest and no pairs. So no list holds back a link between two groups.

Null texts and texts without a word are alike. Texts of fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._graph import components
from ._io import stored
from ._text import chunks, folded, mix, shingles, word_hashes, words
from .simhash import _JOINED, _Sets, near_duplicates, row_key

SHINGLE = 5
SIMILARITY = 0.8
KEY_BYTES, TABLES = 3, 120
#: Bits of the first 64, of 128, and of all 256, in which a candidate pair may differ. At a similarity of 0.8 the means are
#: 10, 20 and 39 at most, with deviations of 3, 4.2 and 6, so all are five deviations off; of unrelated texts 32, 64 and 128.
REACH, PAIR_REACH, WIDE_REACH = 24, 41, 68
#: Texts of so many shingles, whose bits vary more, are paired exactly.
FEW = 32
#: Longer lists are covered by leads in the first round.
SHORT_LIST = 8
_SEEDS = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_POSITIONS = np.stack([np.random.default_rng(17 + i).permutation(32)[:KEY_BYTES] for i in range(TABLES)])


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of texts: how many, the hashes of their distinct shingles (A-Z as a-z), and where each text's begin."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for part, data, offsets in chunks(batch, "text"):
        data = folded(data)
        starts, ends, bounds = words(data, offsets)
        yield part.num_rows, *shingles(word_hashes(data, starts, ends), bounds, shingle)


def bit_counts(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of each document's numbers have each of the 64 bits set: 255 bytes are added at a time, eight to a word."""
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    out = np.zeros((len(n), 8, 8), np.int64)
    if some.size:
        per = -(-n[some] // 255)
        first = np.cumsum(per) - per
        cuts = np.repeat(bounds[:-1][some], per) + (np.arange(int(per.sum())) - np.repeat(first, per)) * 255
        for k in range(8):
            lanes = np.add.reduceat((x >> np.uint64(k)) & np.uint64(0x0101010101010101), cuts)
            out[some, :, k] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out.reshape(len(n), 64)


def wide_bits(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document 32 bytes of fingerprint from its distinct shingles, for each byte its least decided bit, and how
    decided that is. Further hashes of a shingle are mixed from its first."""
    n = np.diff(bounds)[:, None]
    counts = np.concatenate([bit_counts(mix(h + np.uint64(seed)) if j else h, bounds) for j, seed in enumerate(_SEEDS)], axis=1)
    margin = np.abs(2 * counts - n).reshape(-1, 32, 8)
    least = margin.argmin(2)
    decided = np.take_along_axis(margin, least[:, :, None], 2)[:, :, 0] * 255 // np.maximum(n, 1)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little"), (1 << least).astype(np.uint8), np.minimum(255, decided).astype(np.uint8)


def wide_simhash(text: str | None, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``wide_bits`` of one text."""
    ((_, h, bounds),) = shingle_sets(pa.array([text], pa.string()), shingle)
    return tuple(x[0] for x in wide_bits(h, bounds))


_PRINT = "doc_id long, k1 long, k2 int, f0 long, f1 long, f2 long, f3 long, loose binary, decided binary, n int"


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows, h, bounds in shingle_sets(batch.column(3), shingle):
                bits, loose, decided = wide_bits(h, bounds)
                f = np.ascontiguousarray(bits).view(np.int64)
                more = [pa.array([x.tobytes() for x in y], pa.binary()) for y in (loose, decided)]
                own = [c.slice(at, rows) for c in batch.columns[:3]]
                at += rows
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(np.ascontiguousarray(f[:, j])) for j in range(4)], *more, pa.array(np.diff(bounds).astype(np.int32))], names=[x.split()[0] for x in _PRINT.split(", ")])

    return run


def keys_of(bits: np.ndarray, loose: np.ndarray, decided: np.ndarray) -> np.ndarray:
    """Posting keys of fingerprints (rows of 32 bytes): each table's, then each with its least decided bit turned over."""
    at = bits[:, _POSITIONS].astype(np.int64)
    turned = at.copy()
    weakest = decided[:, _POSITIONS].argmin(2)
    row, table = np.ogrid[: len(bits), :TABLES]
    turned[row, table, weakest] ^= loose[row, _POSITIONS[table, weakest]]
    key = np.concatenate([np.broadcast_to(np.arange(TABLES), (len(bits), TABLES))] * 2, axis=1)
    both = np.concatenate([at, turned], axis=1)
    for j in range(KEY_BYTES):
        key = key << 8 | both[:, :, j]
    return key


def _posting(extra: int, schema: str):
    """Rows under each of their keys: key, the first 64 bits, and ``extra`` further columns as they are.

    Takes f0 to f3, loose, decided and the extra columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                f = np.stack([np.asarray(c) for c in part.columns[:4]], axis=1)
                loose, decided = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, 32) for c in part.columns[4:6])
                key = keys_of(np.ascontiguousarray(f).view(np.uint8).reshape(-1, 32), loose, decided)
                again = [pa.array(np.repeat(np.asarray(c), key.shape[1])) for c in [part.column(0), *part.columns[6 : 6 + extra]]]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *again], names=[x.split()[0] for x in schema.split(", ")])

    return run


def nearest_of(v: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lists of one length (rows): members and their nearest partners within reach, by the first 64 bits or by 128
    (``more``), and the members that have further ones."""
    gap = sum(np.bitwise_count(x[:, :, None] ^ x[:, None, :]) for x in (v, *more))
    reach = PAIR_REACH if more else REACH
    own = np.arange(v.shape[1])
    gap[:, own, own] = 255
    nearest = gap.argmin(2)
    row, i = np.nonzero(np.take_along_axis(gap, nearest[:, :, None], 2)[:, :, 0] <= reach)
    return v[row, i], v[row, nearest[row, i]], v[(gap <= reach).sum(2) > 1]


def covered_first(v: np.ndarray, *more_bits: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of places of a long list by the first 64 bits or by 128, and the places that have further partners within reach.

    Whatever is within half the reach of a lead is paired with it only. The leads are the first
    in the order of the bits, so a group has much the same leads in all of its lists. Every member with a partner
    within reach is in a pair.
    """
    out, more = [], []
    reach = PAIR_REACH if more_bits else REACH
    free = np.ones(len(v), bool)
    for i in range(len(v)):
        if not free[i]:
            continue
        gap = sum(np.bitwise_count(x ^ x[i]) for x in (v, *more_bits))
        own = np.flatnonzero(free & (gap <= reach // 2))
        free[own] = False
        own = own[own != i].tolist()
        out += [(j, i) for j in own]
        near = np.flatnonzero(gap <= reach)
        if len(near) > 2 or own:
            more += [i, *own]
        if len(near) > 1:
            gap[i] = 255
            out.append((i, int(gap.argmin())))
    return out, more


def nearest_apart(f: np.ndarray, label: np.ndarray, most: int = 1) -> list[tuple[int, int]]:
    """Places of up to ``most`` nearest pairs of each label with other ones, by all 256 bits, within reach.

    Members of the most frequent label are met from the other side, so a group that is one costs nothing.
    """
    best: dict[int, list[tuple[int, int, int]]] = {}
    names, count = np.unique(label, return_counts=True)
    if len(names) == 1:
        return []
    main = int(names[count.argmax()])
    for i in np.flatnonzero(label != main).tolist():
        own = int(label[i])
        gap = np.bitwise_count(f ^ f[i]).sum(1, dtype=np.int64)
        gap[label == own] = 999
        for back in (False, True):
            at = np.flatnonzero((gap <= WIDE_REACH) & (label == main)) if back else np.flatnonzero(gap <= WIDE_REACH)
            at = at[gap[at].argsort(kind="stable")[:most]].tolist()
            best.setdefault(main if back else own, []).extend((int(gap[j]), j, i) if back else (int(gap[j]), i, j) for j in at)
    return sorted((i, j) for pairs in best.values() for _, i, j in sorted(pairs)[:most])


def _pairs(first: bool, most: int = 1):
    """From rows in key order to pairs of first 64 bits, equal pairs of a stretch of rows once.

    A pair of equal ends says that there are, or may be, further partners within reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[np.ndarray] = []
        kept: list[list[np.ndarray]] = []  # columns of the list that may go on in the next batch

        def out() -> Iterator[pa.RecordBatch]:
            if made:
                a, b = np.unique(np.concatenate(made, axis=1), axis=1)
                made.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def add(a: np.ndarray, b: np.ndarray) -> None:
            if len(a):
                a, b = (np.ascontiguousarray(x).view(np.int64) for x in (a, b))
                made.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))

        def lists(key: np.ndarray, f0: np.ndarray, *more: np.ndarray) -> None:
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
            n = ends - starts
            v = f0.view(np.uint64)
            if not first:
                # Lists of one group give nothing.
                apart = np.flatnonzero(np.minimum.reduceat(more[0], starts) != np.maximum.reduceat(more[0], starts))
                for k in apart.tolist():
                    at = slice(starts[k], ends[k])
                    found = nearest_apart(np.stack([f0[at], *[m[at] for m in more[1:]]], axis=1).view(np.uint64), more[0][at], most)
                    of = Counter(int(more[0][at][i]) for i, _ in found)
                    cut = np.array([i for i, _ in found if of[int(more[0][at][i])] >= most], np.int64)
                    i, j = np.array(found, np.int64).reshape(-1, 2).T
                    add(v[at][i], v[at][j])
                    add(v[at][cut], v[at][cut])
                return
            for size in range(2, SHORT_LIST + 1):
                own = starts[n == size]
                for some in np.array_split(own, max(1, len(own) >> 14)):
                    if len(some):
                        at = some[:, None] + np.arange(size)
                        a, b, further = nearest_of(v[at], *[m.view(np.uint64)[at] for m in more])
                        add(a, b)
                        add(further, further)
            for k in np.flatnonzero(n > SHORT_LIST).tolist():
                ids = v[starts[k] : ends[k]]
                found, further = covered_first(ids, *[m[starts[k] : ends[k]].view(np.uint64) for m in more])
                i, j = np.array(found, np.int64).reshape(-1, 2).T
                add(ids[i], ids[j])
                add(ids[further], ids[further])

        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if not len(cols[0]):
                continue
            other = np.flatnonzero(cols[0] != cols[0][-1])
            cut = int(other[-1]) + 1 if other.size else 0
            if kept and (cut or kept[0][0][0] != cols[0][0]):
                head = int(np.searchsorted(cols[0] != kept[0][0][0], True)) if cols[0][0] == kept[0][0][0] else 0
                whole = [np.concatenate(x) for x in zip(*kept, [c[:head] for c in cols], strict=True)]
                kept = []
                lists(*whole)
                cols, cut = [c[head:] for c in cols], max(0, cut - head)
            if cut:
                lists(*[c[:cut] for c in cols])
            if len(cols[0]) > cut:
                kept.append([c[cut:] for c in cols])
            if sum(x.shape[1] for x in made) > 500_000:
                yield from out()
        if kept:
            lists(*[np.concatenate(x) for x in zip(*kept, strict=True)])
        yield from out()

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows, h, bounds in shingle_sets(batch.column(1), shingle):
                small = (h >> np.uint64(32)).astype(np.uint32)
                sets = [np.unique(small[i:j]).tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(sets, pa.binary())], names=["k1", "s"])
                at += rows

    return run


def _verified(similarity: float):
    """A spanning forest of the pairs of a task that reach the similarity; pairs of what is joined already are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _Sets()
        for batch in batches:
            keep = []
            for a, b, x, y in zip(*[batch.column(i).to_pylist() for i in (0, 1)], batch.column(2), batch.column(3), strict=True):
                apart = tree.root(a) != tree.root(b)
                if apart:
                    x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    apart = both >= similarity * (len(x) + len(y) - both)
                    if apart:
                        tree.join(a, b)
                keep.append(apart)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if len(tree.up) > _JOINED:
                tree.up.clear()

    return run


def link_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Places of a spanning forest of what reaches the similarity among the sets of a list.

    Exact, by balls as in ``simhash.link_list``: one minus the similarity is a metric.
    """
    n = np.array([len(x) for x in sets])
    rows = np.full((len(sets), n.max()), -1, np.int64)
    for i, x in enumerate(sets):
        rows[i, : len(x)] = x
    tree, out = _Sets(), []

    def reach(i: int, at: np.ndarray, least: float) -> np.ndarray:
        both = np.isin(rows[at], sets[i]).sum(1)
        return at[both >= least * (n[at] + n[i] - both)]

    def join(i: int, j: int) -> None:
        if tree.root(i) != tree.root(j):
            tree.join(i, j)
            out.append((i, j))

    every = rest = np.arange(len(sets))
    balls = []
    while rest.size:
        lead = int(rest[0])
        for j in reach(lead, every, similarity).tolist():
            join(lead, j)
        own = reach(lead, rest, (1 + similarity) / 2)
        balls.append((lead, own))
        rest = np.setdiff1d(rest, own, assume_unique=True)
    leads = np.array([lead for lead, _ in balls])
    for a, (lead, own) in enumerate(balls):
        for b in np.flatnonzero(np.isin(leads, reach(lead, leads[a + 1 :], 2 * similarity - 1 - 1e-9))).tolist():
            for i in own.tolist():
                if tree.root(lead) == tree.root(balls[b][0]):
                    break
                for j in reach(i, balls[b][1], similarity)[:1].tolist():
                    join(i, j)
    return out


def link_apart(sets: list[np.ndarray], labels: list[int], similarity: float) -> list[tuple[int, int]]:
    """Places of links of different labels that join whatever reaches the similarity among the sets of a list.

    Members of the most frequent label are met from the other side, so a large group is not compared with itself.
    """
    n, label = np.array([len(x) for x in sets]), np.array(labels, np.int64)
    ends, flat, owner = np.cumsum(n), np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    names, count = np.unique(label, return_counts=True)
    other = np.flatnonzero(label != names[count.argmax()])
    tree, out = _Sets(), []
    for at in np.split(other, np.flatnonzero(np.diff(np.cumsum(n[other]) >> 15)) + 1):
        own = np.unique(np.concatenate([sets[i] for i in at]))
        mine = np.stack([np.isin(own, sets[i]) for i in at]).astype(np.float32)
        step = max(1, (1 << 24) // len(own))
        for first in range(0, len(sets), step):
            last = min(len(sets), first + step)
            part = slice(ends[first] - n[first], ends[last - 1])
            place = np.minimum(np.searchsorted(own, flat[part]), len(own) - 1)
            hit = own[place] == flat[part]
            theirs = np.zeros((last - first, len(own)), np.float32)
            theirs[owner[part][hit] - first, place[hit]] = 1
            both = mine @ theirs.T
            i, j = np.nonzero((both >= similarity * (n[at][:, None] + n[first:last] - both)) & (label[at][:, None] != label[first:last]))
            _, once = np.unique(np.stack([label[at[i]], label[first + j]]), axis=1, return_index=True)
            for a, b in zip(at[i[once]].tolist(), (first + j[once]).tolist(), strict=True):
                if tree.root(labels[a]) != tree.root(labels[b]):
                    tree.join(labels[a], labels[b])
                    out.append((a, b))
    return out


def _set_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column(1)]
        n = np.array([len(x) for x in sets], np.int32)
        again = [np.repeat(np.asarray(batch.column(0)), n), np.concatenate([np.zeros(0, np.uint32), *sets]).astype(np.int64), np.repeat(n, n)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in again], names=["k1", "token", "n"])


def _set_links(similarity: float):
    """From rows (token, key, set, label) in token order to links; without labels (null) each set is its own group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, ids, sets, labels = None, [], [], []

        def out() -> pa.RecordBatch:
            found = link_sets(sets, similarity) if labels[0] is None else link_apart(sets, labels, similarity)
            return pa.RecordBatch.from_arrays([pa.array([ids[p[i]] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for t, k, x, of in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if t != token:
                    if len(ids) > 1:
                        yield out()
                    token, ids, sets, labels = t, [], [], []
                ids.append(k)
                sets.append(np.frombuffer(x, np.uint32))
                labels.append(of)
        if len(ids) > 1:
            yield out()

    return run


def distinct_lists(posts: DataFrame, apart: bool) -> DataFrame:
    """(token) of one list of each set of members, among lists (token, k1, label) of several, of several labels if ``apart``.

    Near copies share many shingles, so many lists have the same members, and each would have their sets brought to it. Lists
    are compared by how many members they have and two 64-bit hashes of them.
    """
    members = posts.groupBy("token").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("k1")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "k1")).alias("x2"), F.min("label").alias("least"), F.max("label").alias("most")
    )
    several = members.where("least <> most" if apart else "members > 1")
    return stored(several.groupBy("members", "x1", "x2").agg(F.min("token").alias("token")).select("token"), "nearcopy-lists")


def _exact_links(sets: DataFrame, labels: DataFrame | None, similarity: float) -> DataFrame:
    """Links (a, b) that join all sets (k1, s) that reach the similarity; with labels (k1, label), those of different ones.

    Sets that reach it share one of the rarest shingles of each, as many as a set can lack, and one more. Lists of
    one label give nothing, and lists with the members of another nothing new: they are left out before sets meet them.
    """
    tokens = stored(sets.mapInArrow(_set_tokens, "k1 long, token long, n int"), "nearcopy-tokens")
    # A shingle of one set makes no list and is not shuffled further, but has its place among the rarest.
    frequent = stored(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "nearcopy-frequent")
    shared = stored(tokens.join(frequent, "token"), "nearcopy-shared")
    rarest = Window.partitionBy("k1").orderBy("df", "token")
    ranked = shared.withColumn("r", F.row_number().over(rarest) + F.col("n") - F.count("*").over(Window.partitionBy("k1")))
    posts = ranked.where(F.col("r") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).select("token", "k1")
    posts = posts.withColumn("label", F.lit(None).cast("long")) if labels is None else posts.join(labels, "k1")
    posts = stored(posts, "nearcopy-posts")
    posts = posts.join(distinct_lists(posts, labels is not None), "token", "left_semi")
    posts = posts.join(sets, "k1").select("token", "k1", "s", "label")
    return posts.repartition(F.col("token")).sortWithinPartitions("token", "k1").mapInArrow(_set_links(similarity), "a long, b long").distinct()


def _few_links(text: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that join all texts of few shingles that reach the similarity with another text.

    A text that reaches it with one of few shingles has few more itself.
    """
    some = nodes.where(F.col("n") <= FEW / similarity).select("k1")
    sets = text.select("k1", "text").join(some, "k1", "left_semi").mapInArrow(_sets(shingle), "k1 long, s binary")
    sets = stored(sets.groupBy("k1").agg(F.min("s").alias("s")), "nearcopy-few")
    return _exact_links(sets, None, similarity)


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, k1, k2, root), one row per input row; root is the same in a group of near copies."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text")
    by_simhash = near_duplicates(text.select(F.col("k1").alias("doc_id"), "text"))
    known = stored(by_simhash.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).where("a <> b").distinct(), "nearcopy-simhash")
    prints = stored(text.mapInArrow(_prints(shingle), _PRINT), "nearcopy-prints")
    wide = ["f0", "f1", "f2", "f3"]
    least = F.min(F.struct("k1", "f1", "f2", "f3", "loose", "decided", "n")).alias("x")
    nodes = stored(prints.groupBy("f0").agg(least).select("f0", "x.*"), "nearcopy-nodes")
    schema = "key long, f0 long, f1 long"
    posts = nodes.select(*wide, "loose", "decided", F.col("f1").alias("g1")).mapInArrow(_posting(1, schema), schema)
    pairs = posts.repartition(F.col("key")).sortWithinPartitions("key", "f0").mapInArrow(_pairs(True), "a long, b long").distinct()
    pairs = stored(pairs, "nearcopy-first")
    further = pairs.where("a = b").select(F.col("a").alias("f0")).join(nodes, "f0").select("k1")
    pairs = _wide_pairs(pairs.where("a <> b"), nodes)
    # Other texts with the same first 64 bits are paired with the one that stands for them.
    same = prints.select("f0", F.col("k1").alias("kb")).distinct().join(nodes.select("f0", "k1"), "f0").where("kb <> k1").select("f0", F.col("f0").alias("f0b"), F.col("k1").alias("ka"), "kb")
    pairs = stored(pairs.unionAll(same.toDF("a", "b", "ka", "kb")), "nearcopy-pairs")
    wanted = pairs.select(F.col("ka").alias("k1")).unionAll(pairs.select(F.col("kb").alias("k1"))).unionAll(further).distinct()
    wanted = stored(wanted, "nearcopy-wanted")
    sets = text.select("k1", "text").join(wanted, "k1", "left_semi").mapInArrow(_sets(shingle), "k1 long, s binary")
    sets = stored(sets.groupBy("k1").agg(F.min("s").alias("s")), "nearcopy-sets")
    links = _verify(pairs.select("ka", "kb"), sets, similarity).unionAll(_few_links(text, nodes, shingle, similarity)).unionAll(known)
    links = stored(links, "nearcopy-links")
    roots = components(links)
    found = nodes.join(wanted, "k1", "left_semi").join(roots.withColumnRenamed("node", "k1"), "k1", "left").withColumn("label", F.coalesce("root", "k1"))
    found = stored(found.drop("root"), "nearcopy-labels")
    open_groups = stored(_apart(found).join(found.select("f0", "label"), "f0").select("label").distinct(), "nearcopy-open")
    some = found.join(open_groups, "label", "left_semi").select("k1", "label")
    new = stored(_exact_links(sets.join(some.select("k1"), "k1", "left_semi"), some, similarity), "nearcopy-links")
    if not new.isEmpty():
        roots = _joined_further(roots, some, new)
    return prints.select("doc_id", "k1", "k2").join(roots.withColumnRenamed("node", "k1"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))


def _joined_further(roots: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) when groups are joined by ``links`` (a, b) of texts with ``labels`` (k1, label): only groups are joined."""
    of = lambda x: labels.select(F.col("k1").alias(x), F.col("label").alias(f"of_{x}"))
    above = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    whole = roots.unionAll(labels.select("label", "label").toDF("node", "root").join(roots.select("node"), "node", "left_anti").distinct())
    up = above.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return whole.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))


def _apart(labelled: DataFrame) -> DataFrame:
    """(f0) of members, at least one of each group with a member that is within reach of another group's in some list."""
    apart = labelled.select("f0", "f1", "f2", "f3", "loose", "decided", "label", F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("f3").alias("g3"))
    schema = "key long, f0 long, label long, f1 long, f2 long, f3 long"
    posts = apart.mapInArrow(_posting(4, schema), schema)
    pairs = posts.repartition(F.col("key")).sortWithinPartitions("key", "f0").mapInArrow(_pairs(False), "a long, b long")
    return pairs.where("a = b").select(F.col("a").alias("f0")).distinct()


def _wide_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of first 64 bits whose 256 bits are within reach, with the keys of their texts (ka, kb)."""
    side = lambda x: nodes.select(F.col("f0").alias(x), F.col("k1").alias(f"k{x}"), *[F.col(f"f{i}").alias(f"{x}{i}") for i in (1, 2, 3)])
    gap = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in (1, 2, 3)), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(gap <= WIDE_REACH).select("a", "b", "ka", "kb")


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (ka, kb) whose shingle sets reach the similarity, as (a, b)."""
    both = pairs.join(sets.toDF("ka", "sa"), "ka").join(sets.toDF("kb", "sb"), "kb").select("ka", "kb", "sa", "sb")
    return both.mapInArrow(_verified(similarity), "a long, b long")


def text_key() -> list:
    """A key of the text, null as empty, and the two of the row."""
    return [F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"), row_key()[1]]


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id (null last).

    Several rows with that doc_id are told apart by hashes of their text; of repeats of one row one stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2"))
    keep = near_copies(docs, shingle, similarity).groupBy("root").agg(first.alias("k")).select("k.k1", "k.k2")
    names = {"k1": "_lexigrid_k1", "k2": "_lexigrid_k2"}
    k1, k2 = text_key()
    kept = docs.withColumns({names["k1"]: k1, names["k2"]: k2}).join(keep.withColumnsRenamed(names), list(names.values()), "left_semi")
    one = Window.partitionBy(*names.values()).orderBy(*names.values())
    return kept.withColumn("_lexigrid_n", F.row_number().over(one)).where("_lexigrid_n = 1").select(*docs.columns)
