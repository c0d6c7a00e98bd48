"""Scoring texts with a hierarchical Pitman-Yor language model over words in context.

Five kinds of restaurants, each the parent of the one before:

* the context of a word is the word before it, and each word that was learned has a restaurant whose dishes are
  the words that follow; those of words of one class share a parent;
* each class of words has a restaurant whose dishes
  are the classes of the words that follow; a class is a hash of a word's last three bytes, so the tables
  of all contexts have a bounded size, while their customers are all bigrams of the corpus;
* contexts share a root restaurant over classes; its base is what the word restaurant gives to each class;
* the word restaurant's dishes are the words; its base spells them;
* words are spelled by restaurants of the two bytes before, of the one byte before, and of a byte root
  shared by all, whose base is uniform. So every word, seen or not, has a probability.

What the parent gives to a word in its context is its probability in the word restaurant, times what the class of the
context gives to its class, over what the word restaurant gives to it. The end of a text is a word without bytes, with
a class of its own, and the context in which a text begins. ``score`` counts words that were not learned as
one type, as the base score does, which is a class as well; ``spelled_score`` has their spelling in addition.

Seating is sampled by Gibbs sweeps over the numbers of tables: all customers of a dish stand up, and its
tables are drawn from their exact distribution given the tables of the others (generalized Stirling numbers
sum over all seatings; beyond ``SINGLY`` customers the others sit down in stretches of a sixteenth of those
seated). Dishes of the word restaurant are seated in parallel with the other dishes' tables as the sweep
before left them. Random numbers come from a hash of the word and the sweep, so reruns and retried tasks
agree. Predictive probabilities are averaged over the sweeps after the burn-in.

Words are counted in blocks of documents: a block holds a bounded vocabulary and a bounded number of words,
asks for the counts and probabilities of its words only, and the answers, packed by block, meet its documents again, as
packed word numbers in their order. A block's pairs of words are dealt out by the word before, with their
documents; restaurants are seated there, and sums by document come back. Words are told apart there by their class and
46 bits of a hash. Tables are deleted when the next one is made from them, so few are held at a time. What is shuffled grows with the words of the corpus. Byte statistics, of which
there are at most 257^3, and class bigrams, at most ``CLASSES`` squared, reach the driver.

Null texts are empty: they consist of the end alone. Rows are scored one by one, repeats included.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._fold import in_fold
from ..session import discard, worker_env
from ._io import stored, table
from ._text import mix, word_hashes

#: Distinct words, and words, of a block, at which it is closed with the documents that reached it.
BLOCK_WORDS, BLOCK_TOKENS = 600_000, 1 << 22
BURN_IN = 3
SAMPLES = 4
SINGLY = 64
STRENGTH = 10.0
BYTE_DISCOUNT = (0.3, 0.5, 0.6)
BYTE_STRENGTH = (1.0, 1.0, 1.0)
CLASS_STRENGTH = 5.0
CONTEXT_STRENGTH = 2.0
#: Words whose contexts are seated together; restaurants of more customers are divided.
BUCKET_TOKENS = 1 << 21
#: Bytes, and one symbol for the edge of a word.
SYMBOLS = 257
EDGE = 256
#: Classes of words; the end of a text and words that were not learned have one each.
CLASSES, END, UNKNOWN = 1024, 0, 1
#: Groups of contexts in which class bigrams are added up.
_CELL_GROUPS = 64
_PART = "kind int, block long, doc_id long, held_out boolean, refs binary, ref int, word binary, seen long, cells binary"
#: Kinds of its rows: documents, words of a block, class bigrams.
_DOCS, _WORDS, _CELLS = 0, 1, 2
#: Bits of the hash that tells words of one class apart in contexts.
_ID_BITS = 46
_ANSWER = "block long, ref binary, c binary, logp binary, id binary"
#: Answers that a task packs together.
_ANSWERS = 1 << 20
#: Pairs that are seated, and occurrences that are added up, at a time.
_STRETCH = 1 << 18
#: Memory of this many bytes, most arrays here, is used again instead of given back and taken anew, which took half of the time.
_WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "8388608"}


@lru_cache(8)
def _stirling(discount: float) -> np.ndarray:
    """Logs of the generalized Stirling numbers: seatings of n customers at t tables, n and t up to ``SINGLY``."""
    out = np.full((SINGLY + 1, SINGLY + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, SINGLY + 1)
    for n in range(1, SINGLY):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= n, np.log(np.maximum(n - discount * t, 1e-300)), -np.inf)
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], out[n, 1:] + stay)
    return out


def _uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """A number above 0 and below 1 for each key and draw."""
    return ((mix(keys + np.uint64(draw * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def seat(customers: np.ndarray, mass: np.ndarray, parent: np.ndarray, discount: float, keys: np.ndarray) -> np.ndarray:
    """Tables of each dish given those of the others; mass: strength + discount * tables of the other dishes,
    parent: the dish's probability in the parent restaurant, keys: what random numbers come from."""
    tables = np.minimum(customers, 1).astype(np.float64)
    first = np.minimum(customers, SINGLY)
    order = np.argsort(first, kind="stable")
    ends = np.cumsum(np.bincount(first, minlength=SINGLY + 1))
    ways, logp = _stirling(discount), np.log(np.maximum(parent, 1e-300))
    for n in range(2, SINGLY + 1):
        for at in np.array_split(order[ends[n - 1] : ends[n]], max(1, (ends[n] - ends[n - 1]) * n >> 18)):
            if not len(at):
                continue
            t = np.arange(1, n + 1)
            z = ways[n, 1 : n + 1] + t * logp[at, None] + np.cumsum(np.log(mass[at, None] + discount * (t - 1)), axis=1)
            upto = np.cumsum(np.exp(z - z.max(1, keepdims=True)), axis=1)
            tables[at] = 1 + (upto[:, :-1] < _uniform(keys[at], 0)[:, None] * upto[:, -1:]).sum(1)
    live = np.flatnonzero(customers > SINGLY)
    seated, draw = np.full(len(customers), SINGLY, np.int64), 1
    while live.size:
        stretch = np.minimum(customers[live] - seated[live], np.maximum(1, seated[live] // 16))
        weight = (mass[live] + discount * tables[live]) * parent[live]
        new = np.clip(weight / (weight + seated[live] + stretch / 2 - discount * tables[live]), 0, 1)
        normal = np.sqrt(-2 * np.log(_uniform(keys[live], draw))) * np.cos(2 * np.pi * _uniform(keys[live], draw + 1))
        tables[live] += np.clip(np.round(stretch * new + np.sqrt(stretch * new * (1 - new)) * normal), 0, stretch)
        seated[live] += stretch
        draw += 2
        live = live[customers[live] > seated[live]]
    return tables


def word_classes(lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Class of each of the words laid end to end in ``data``: a hash of the last three bytes."""
    ends = np.cumsum(lengths)
    tail = np.zeros(len(lengths), np.uint64)
    for j in (1, 2, 3):
        tail *= np.uint64(SYMBOLS)
        some = lengths >= j
        tail[some] += data[ends[some] - j].astype(np.uint64) + np.uint64(1)
    found = (mix(tail) % np.uint64(CLASSES - 2)).astype(np.int64) + 2
    return np.where(lengths > 0, found, END)


_PACKED = ["part", "hu", "cu", "nu", "hw", "pw", "wi", "seen", "ni", "di"]
_SUMS = "block long, doc int, doc_id long, held_out boolean, n long, sums binary"
_SUM_COLUMNS = [x.split()[0] for x in _SUMS.split(", ")]
_SUM_TYPE = pa.schema([("block", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("sums", pa.binary())])
_DEALT = f"{_SUMS}, part int, " + ", ".join(f"{x} binary" for x in _PACKED[1:])
_DEALT_TYPE = pa.schema([*_SUM_TYPE, ("part", pa.int32()), *[(x, pa.binary()) for x in _PACKED[1:]]])


def place_of_end(kind: np.ndarray) -> int:
    """Place of the end of a text, the only word without bytes, among a block's words."""
    return int(np.flatnonzero(kind == END)[0]) if len(kind) else 0


def splits_of(c: np.ndarray) -> np.ndarray:
    """Into how many parts, by their dishes, restaurants of so many customers are divided."""
    return 1 + c // BUCKET_TOKENS


def pack_contexts(before: np.ndarray, r: np.ndarray, doc: np.ndarray, learned: np.ndarray, ids: np.ndarray, c: np.ndarray, closed: np.ndarray, buckets: int) -> list[dict]:
    """Occurrences of words after words of a block, a row for each bucket of contexts: the contexts, the words, and for each
    distinct pair its word, how often it is learned from, and the documents that it is in. Words are places in ``ids``, which
    ascend; ``learned`` says of each document whether it is learned from. How often a context is met is the sum over its
    words, and sent only of those that are divided."""
    if not len(r):
        return []
    u, splits = ids.view(np.uint64), splits_of(c)
    # Two bytes are sorted by their digits, in one pass each.
    part = (mix(u) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)[before]
    divided = np.flatnonzero((splits > 1)[before])
    part[divided] = (mix(u)[before[divided]] + mix(u + np.uint64(1))[r[divided]] % splits[before[divided]].astype(np.uint64)) % np.uint64(buckets)
    del divided
    ends = np.cumsum(np.bincount(part, minlength=buckets))
    order, out = part.argsort(kind="stable"), []
    del part
    for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        # A bucket at a time, so that little is held beside the occurrences themselves.
        mine = order[ends[k - 1] if k else 0 : ends[k]]
        key = before[mine].astype(np.int64) * len(ids) + r[mine]
        inner = key.argsort(kind="stable")
        mine, key = mine[inner], key[inner]
        first = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
        pu, pw = key[first] // len(ids), key[first] % len(ids)
        own = np.r_[0, np.flatnonzero(pu[1:] != pu[:-1]) + 1]
        us, (ws, at) = pu[own], np.unique(pw, return_inverse=True)
        docs = doc[mine]
        out.append({
            "part": k, "hu": packed_ids(ids[us]), "cu": packed(np.where(splits[us] > 1, c[us], 0)), "nu": packed(np.diff(np.r_[own, len(pu)])),
            "hw": packed_ids(ids[ws]), "pw": packed(closed[ws].astype("<f4").view("<u4")), "wi": packed(at),
            "seen": packed(np.add.reduceat(learned[docs].astype(np.int64), first)), "ni": packed(np.diff(np.r_[first, len(mine)])), "di": packed(docs),
        })
    return out


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in ascending order, and the place of each of ``x`` among them."""
    order = x.argsort(kind="stable")
    x = x[order]
    new = np.r_[np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], at


def context_sums(packs: list[dict], ratio: np.ndarray, burn_in: int, samples: int) -> list[dict]:
    """For each of the rows of ``pack_contexts`` the sums by document of log10 of the probabilities of words in their contexts.

    A restaurant for each word before, its dishes are words. Its parent gives a word's probability after the class of the
    word before. Of restaurants that are divided a part stands for the tables of all. Only distinct pairs are held;
    documents of the occurrences are unpacked a row at a time, when the sums are made.
    """
    if not packs:
        return []
    us, ui = _numbered(np.concatenate([unpacked_ids(x["hu"]) for x in packs]))
    ws, wi = _numbered(np.concatenate([unpacked_ids(x["hw"]) for x in packs]))
    cu, pw = np.zeros(len(us), np.int64), np.zeros(len(ws))
    cu[ui] = np.concatenate([unpacked(x["cu"]) for x in packs])
    pw[wi] = np.concatenate([unpacked(x["pw"]).astype("<u4").view("<f4") for x in packs])
    keys, seen, ends, au, aw = [], [], [0], 0, 0
    for x in packs:
        n, at = unpacked(x["nu"]), unpacked(x["wi"])
        upto = int(at.max()) + 1  # each of a row's words is in a pair
        keys.append(np.repeat(ui[au : au + len(n)].astype(np.int64) * len(ws), n) + wi[aw : aw + upto][at])
        seen.append(unpacked(x["seen"]).astype(np.int32))
        ends.append(ends[-1] + len(at))
        au, aw = au + len(n), aw + upto
    keys, seen = np.concatenate(keys), np.concatenate(seen)
    pair, at = _numbered(keys)
    del keys, ui, wi
    customers = np.bincount(at, seen).astype(np.int64)
    context, dish = (pair // len(ws)).astype(np.int32), (pair % len(ws)).astype(np.int32)
    cu = np.maximum(cu, np.bincount(context, customers, len(us)).astype(np.int64))
    ku, kw, mixed = us >> _ID_BITS, ws >> _ID_BITS, mix(us.view(np.uint64))
    del pair, seen
    stretches = lambda n: (slice(i, i + _STRETCH) for i in range(0, n, _STRETCH))
    parent, p = np.empty(len(dish)), np.zeros(len(dish))
    for j in stretches(len(dish)):
        parent[j] = 10.0 ** (pw[dish[j]] + ratio[ku[context[j]], kw[dish[j]]])
    once, twice = int((customers == 1).sum()), int((customers == 2).sum())
    d = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    share = splits_of(cu)
    t, many = np.minimum(customers, 1).astype(np.float64), np.flatnonzero(customers > 1)
    for sweep in range(burn_in + samples):
        every, salt = np.bincount(context, t, len(us)) * share, mix(np.array([sweep + 501], np.uint64))
        for j in stretches(len(many)):
            m = many[j]
            seeds = mix(mixed[context[m]] + ws.view(np.uint64)[dish[m]])
            t[m] = seat(customers[m], CONTEXT_STRENGTH + d * (every[context[m]] - t[m]), parent[m], d, mix(seeds + salt))
        if sweep >= burn_in:
            back = CONTEXT_STRENGTH + d * (np.bincount(context, t, len(us)) * share)
            for j in stretches(len(p)):
                p[j] += (np.maximum(customers[j] - d * t[j], 0) + back[context[j]] * parent[j]) / (CONTEXT_STRENGTH + cu[context[j]])
    logp, out = np.log10(np.maximum(p / samples, 1e-300)), []
    for x, i, j in zip(packs, ends[:-1], ends[1:], strict=True):
        sums = np.bincount(unpacked(x["di"]), np.repeat(logp[at[i:j]], unpacked(x["ni"])))
        out.append({"block": x["block"], "n": x["part"], "sums": zlib.compress(sums.astype("<f4").tobytes(), 1)})
    return out


@dataclass
class Spelling:
    """Predictive probabilities of a byte after two bytes (rows for contexts that were seen) and after one."""

    row: np.ndarray
    two: np.ndarray
    one: np.ndarray

    def log_probability(self, lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
        context, symbol, first = symbols(lengths, data)
        row = self.row[context]
        p = np.where(row >= 0, self.two[np.maximum(row, 0), symbol], self.one[context % SYMBOLS, symbol])
        return np.add.reduceat(np.log(p.astype(np.float64)), first) if len(first) else np.zeros(0)


def symbols(lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words laid end to end: context and symbol of each step, ends of words included, and first steps."""
    n = len(lengths)
    stops = np.cumsum(lengths + 1) - 1
    first = stops - lengths
    symbol = np.full(len(data) + n, EDGE, np.int64)
    inner = np.ones(len(symbol), bool)
    inner[stops] = False
    symbol[inner] = data
    one = np.full(len(symbol), EDGE, np.int64)
    one[1:] = symbol[:-1]
    one[first] = EDGE
    two = np.full(len(symbol), EDGE, np.int64)
    two[1:] = one[:-1]
    two[first] = EDGE
    return two * SYMBOLS + one, symbol, first


def uniform_spelling() -> Spelling:
    flat = np.full((SYMBOLS, SYMBOLS), 1 / SYMBOLS, np.float32)
    return Spelling(np.full(SYMBOLS**2, -1, np.int32), np.zeros((1, SYMBOLS), np.float32), flat)


def sample_spelling(keys: np.ndarray, customers: np.ndarray, old: Spelling, sweep: int) -> Spelling:
    """One sweep over the byte restaurants from (context, symbol) keys and their customers."""
    seed = mix(np.array([sweep + 1], np.uint64))
    context, symbol = keys // SYMBOLS, keys % SYMBOLS
    seen, at = np.unique(context, return_inverse=True)

    def tables_of(group: np.ndarray, groups: int, c: np.ndarray, parent: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        d, s = BYTE_DISCOUNT[level], BYTE_STRENGTH[level]
        t = np.minimum(c, 1).astype(np.float64)
        for turn in range(2):  # tables of the restaurant weigh in, so its dishes are seated twice
            total = np.bincount(group, t, groups)
            t = seat(c, s + d * (total[group] - t), parent, d, mix(np.arange(len(c), dtype=np.uint64) + seed + np.uint64(8 * level + turn)))
        return t, np.bincount(group, t, groups)

    def predictive(group: np.ndarray, groups: int, sym: np.ndarray, c: np.ndarray, t: np.ndarray, total: np.ndarray, parent: np.ndarray, level: int) -> np.ndarray:
        d, s = BYTE_DISCOUNT[level], BYTE_STRENGTH[level]
        out = (s + d * total)[:, None] * parent
        np.add.at(out, (group, sym), np.maximum(c - d * t, 0))
        return out / (s + np.bincount(group, c, groups))[:, None]

    t2, all2 = tables_of(at, len(seen), customers, old.one[context % SYMBOLS, symbol].astype(np.float64), 2)
    key1, at1 = np.unique((context % SYMBOLS) * SYMBOLS + symbol, return_inverse=True)
    c1, g1, s1 = np.bincount(at1, t2).astype(np.int64), key1 // SYMBOLS, key1 % SYMBOLS
    root = old.one.mean(0).astype(np.float64)
    t1, all1 = tables_of(g1, SYMBOLS, c1, root[s1], 1)
    s0, at0 = np.unique(s1, return_inverse=True)
    c0 = np.bincount(at0, t1).astype(np.int64)
    zero = np.zeros(len(s0), np.int64)
    flat = np.full((1, SYMBOLS), 1 / SYMBOLS)
    t0, all0 = tables_of(zero, 1, c0, flat[0, s0], 0)
    p0 = predictive(zero, 1, s0, c0, t0, all0, flat, 0)
    p1 = predictive(g1, SYMBOLS, s1, c1, t1, all1, np.repeat(p0, SYMBOLS, 0), 1)
    p2 = predictive(at, len(seen), symbol, customers, t2, all2, p1[seen % SYMBOLS], 2)
    row = np.full(SYMBOLS**2, -1, np.int32)
    row[seen] = np.arange(len(seen))
    return Spelling(row, p2.astype(np.float32), p1.astype(np.float32))


def packed(x: np.ndarray) -> bytes:
    """Numbers below 2^32 by planes of bytes, lowest first, compressed."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def packed_ids(x: np.ndarray) -> bytes:
    """Ascending numbers as differences, by planes of bytes, compressed."""
    return zlib.compress(np.ascontiguousarray(np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked_ids(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _packed_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (block, ref, class, c, logp, hash) to a row for each block of what a task has, in order of ref."""
    waiting, n = [], 0

    def out() -> pa.RecordBatch:
        block, ref, kind, c, logp, h = (np.concatenate([x[i] for x in waiting]) for i in range(6))
        ids = (kind.astype(np.int64) << _ID_BITS) | (h.view(np.uint64) >> np.uint64(64 - _ID_BITS)).astype(np.int64)
        order = np.lexsort((ref, block))
        block, ref, c, logp, ids = (x[order] for x in (block, ref, c, logp, ids))
        cuts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
        rows = [(packed(np.diff(ref[i:j], prepend=0)), packed(c[i:j]), logp[i:j].astype("<f4").tobytes(), zlib.compress(np.ascontiguousarray(ids[i:j].view(np.uint8).reshape(-1, 8).T).tobytes(), 1)) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), *[pa.array(x, pa.binary()) for x in zip(*rows, strict=True)]], names=[x.split()[0] for x in _ANSWER.split(", ")])

    for batch in batches:
        if batch.num_rows:
            waiting.append([np.asarray(c) for c in batch.columns])
            n += batch.num_rows
        if n >= _ANSWERS:
            yield out()
            waiting, n = [], 0
    if waiting:
        yield out()


def answers_of(packs: pa.Table) -> tuple[np.ndarray, ...]:
    """(c, logp, id) of a block's words, in their places, from rows of ``_packed_answers``."""
    ref, c, logp, ids = [], [], [], []
    for x in packs.select(["ref", "c", "logp", "id"]).to_pylist():
        ref.append(np.cumsum(unpacked(x["ref"])))
        c.append(unpacked(x["c"]))
        logp.append(np.frombuffer(x["logp"], "<f4").astype(np.float64))
        ids.append(np.ascontiguousarray(np.frombuffer(zlib.decompress(x["id"]), np.uint8).reshape(8, -1).T).view("<i8").ravel())
    if not ref:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    order = np.concatenate(ref).argsort(kind="stable")
    return tuple(np.concatenate(x)[order] for x in (c, logp, ids))


class _Places(dict):
    """Numbers of words in the order in which they come up."""

    def __init__(self) -> None:
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        return n


def _rows(kind: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of ``_PART`` in which the columns that are not given are null."""
    n = len(next(iter(columns.values())))
    columns["kind"] = pa.array(np.full(n, kind, np.int32))
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = [x.split() for x in _PART.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, types[t]) for c, t in names], names=[c for c, _ in names])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as word numbers of their block, the words of each block, and this task's class bigrams."""
    block = TaskContext.get().partitionId() << 32
    place, tokens = _Places(), 0
    seen, classes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    bigrams, waiting = np.zeros(CLASSES**2, np.int64), []

    def add_up() -> None:
        nonlocal bigrams
        if waiting:
            bigrams += np.bincount(np.concatenate(waiting), minlength=CLASSES**2)
            waiting.clear()

    def vocabulary() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(place.names), 1 << 16):
            part = place.names[i : i + (1 << 16)]
            n = len(part)
            yield _rows(_WORDS, block=pa.array(np.full(n, block)), ref=pa.array(np.arange(i, i + n, dtype=np.int32)), word=pa.array(part, pa.binary()), seen=pa.array(seen[i : i + n]))

    for batch in batches:
        ids, held, texts = batch.columns
        for i in range(0, batch.num_rows, 128):
            out, known, refs = held.slice(i, 128).to_pylist(), len(place.names), []
            for text in texts.slice(i, 128):
                own = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                own.append(b"")
                refs.append(np.array(list(map(place.__getitem__, own)), np.int64))
            fresh = place.names[known:]
            if len(place.names) > len(seen):
                seen, classes = (np.concatenate([x, np.zeros(max(len(x), len(place.names) - len(x)), np.int64)]) for x in (seen, classes))
            classes[known : len(place.names)] = word_classes(np.array([len(w) for w in fresh], np.int64), np.frombuffer(b"".join(fresh), np.uint8))
            learned = [r for r, h in zip(refs, out, strict=True) if not h]
            if learned:
                every = np.concatenate(learned)
                seen[: len(place.names)] += np.bincount(every, minlength=len(place.names))
                after = classes[every]
                # A text ends with the end, so the word before a text's first one is the end as well.
                waiting.append(np.concatenate([[END], after[:-1]]) * CLASSES + after)
            tokens += sum(map(len, refs))
            yield _rows(_DOCS, block=pa.array(np.full(len(refs), block)), doc_id=ids.slice(i, 128), held_out=held.slice(i, 128), refs=pa.array([packed(r) for r in refs], pa.binary()))
            if sum(map(len, waiting)) > 1 << 20:
                add_up()
            if len(place.names) >= BLOCK_WORDS or tokens >= BLOCK_TOKENS:
                yield from vocabulary()
                place, tokens = _Places(), 0
                seen[:] = 0
                block += 1
    yield from vocabulary()
    add_up()
    groups = np.array_split(np.arange(CLASSES**2), _CELL_GROUPS)
    for g, own in enumerate(groups):
        some = np.flatnonzero(bigrams[own])
        if len(some):
            n = bigrams[own][some]
            yield _rows(_CELLS, block=pa.array([g]), cells=pa.array([zlib.compress(np.stack([own[some], n]).astype("<i8").tobytes(), 1)], pa.binary()))


def class_bigrams(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context * CLASSES + class) and counts of the class bigrams of all tasks."""

    def run(group: pa.Table) -> pa.Table:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x in group.column("cells"):
            k, n = np.frombuffer(zlib.decompress(x.as_py()), "<i8").reshape(2, -1)
            keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, n])).astype(np.int64)
        return pa.table([pa.array(keys), pa.array(sums)], names=["key", "n"])

    got = parts.where(F.col("kind") == _CELLS).select("block", "cells").groupBy("block").applyInArrow(run, "key long, n long").toArrow()  # at most CLASSES^2 rows
    keys, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def context_ratios(keys: np.ndarray, customers: np.ndarray, base: np.ndarray, burn_in: int, samples: int) -> np.ndarray:
    """log10 of what each context gives to a class over what the word restaurant gives (``base``), by Gibbs
    sweeps over the context restaurants and their shared root."""
    context, dish = keys // CLASSES, keys % CLASSES
    if not len(keys):
        return np.zeros((CLASSES, CLASSES), np.float32)
    once, twice = int((customers == 1).sum()), int((customers == 2).sum())
    d = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    served = np.bincount(context, customers, CLASSES)
    t, t0 = np.minimum(customers, 1).astype(np.float64), np.zeros(CLASSES)
    root, total = base.copy(), np.zeros((CLASSES, CLASSES))
    for sweep in range(burn_in + samples):
        salt = mix(np.array([sweep + 77], np.uint64))
        all_t = np.bincount(context, t, CLASSES)
        t = seat(customers, CLASS_STRENGTH + d * (all_t[context] - t), root[dish], d, mix(keys.astype(np.uint64) + salt))
        sent = np.bincount(dish, t, CLASSES).astype(np.int64)
        t0 = seat(sent, CLASS_STRENGTH + d * (t0.sum() - t0), base, d, mix(np.arange(CLASSES, dtype=np.uint64) + salt * np.uint64(3)))
        root = (np.maximum(sent - d * t0, 0) + (CLASS_STRENGTH + d * t0.sum()) * base) / (CLASS_STRENGTH + sent.sum())
        if sweep >= burn_in:
            back = CLASS_STRENGTH + d * np.bincount(context, t, CLASSES)
            p = back[:, None] * root
            p[context, dish] += np.maximum(customers - d * t, 0)
            total += p / (CLASS_STRENGTH + served)[:, None]
    return np.log10(np.maximum(total / samples, 1e-300) / np.maximum(base, 1e-300)).astype(np.float32)


def _word_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.diff(offsets), data


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1 << 15):
            yield batch.slice(i, 1 << 15)


def _keys(lengths: np.ndarray, data: np.ndarray, sweep: int) -> np.ndarray:
    """What the random numbers of words come from in a sweep."""
    ends = np.cumsum(lengths)
    return mix(word_hashes(data, ends - lengths, ends) + mix(np.array([sweep], np.uint64)))


def sweeps(vocabulary: DataFrame, discount: float, distinct: int, burn_in: int, samples: int) -> list[tuple[float, Spelling, float]]:
    """(tables, spelling, spelling probability of all learned words) after each sweep that counts.

    One sweep more than that sums the last one's probabilities.
    """
    spark = vocabulary.sparkSession
    kept, state, tables = [], uniform_spelling(), float(distinct)
    for sweep in range(burn_in + samples + 1):
        shared = spark.sparkContext.broadcast((tables, state))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, sweep=sweep) -> Iterator[pa.RecordBatch]:
            total, old = shared.value
            keys, sums, drawn, spelled = np.zeros(0, np.int64), np.zeros(0, np.float64), 0.0, 0.0
            for batch in _slices(batches):
                lengths, data = _word_bytes(batch.column(0))
                c = np.asarray(batch.column(1))
                h = np.exp(old.log_probability(lengths, data))
                t = seat(c, np.full(len(c), STRENGTH + discount * max(0.0, total - 1)), h, discount, _keys(lengths, data, sweep))
                drawn += t.sum()
                spelled += h.sum()
                context, symbol, _ = symbols(lengths, data)
                keys = np.concatenate([keys, context * SYMBOLS + symbol])
                sums = np.concatenate([sums, np.repeat(t, lengths + 1)])
                keys, at = np.unique(keys, return_inverse=True)
                sums = np.bincount(at, sums)
            keys, sums = np.append(keys, [-1, -2]), np.append(sums, [drawn, spelled])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["key", "n"])

        got = vocabulary.where("c > 0").mapInArrow(run, "key long, n double").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
        order = np.argsort(key)
        key, n = key[order], n[order]
        shared.unpersist()
        if sweep > burn_in:
            kept.append((tables, state, min(1.0, float(n[key == -2].sum()))))
        tables = float(n[key == -1].sum())
        seen = key >= 0
        if seen.any():
            state = sample_spelling(key[seen], np.round(n[seen]).astype(np.int64), state, sweep)
    return kept


def probabilities(vocabulary: DataFrame, kept: list[tuple[float, Spelling, float]], discount: float, total: int) -> DataFrame:
    """(word, class, c, logp): log10 of the averaged predictive probability of each word in the word restaurant."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(kept)  # at most 257^3 numbers a sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            lengths, data = _word_bytes(batch.column(0))
            c = np.asarray(batch.column(1))
            p = np.zeros(len(c))
            logs = []
            for i, (tables, spelling, _) in enumerate(shared.value):
                logh = spelling.log_probability(lengths, data)
                back = STRENGTH + discount * tables
                t = seat(c, np.full(len(c), back), np.exp(logh), discount, _keys(lengths, data, 1000 + i))
                p += np.maximum(c - discount * t, 0)
                logs.append(np.log(back) + logh)
            spelled = np.logaddexp.reduce(logs, axis=0)
            with np.errstate(divide="ignore"):
                logp = np.logaddexp(np.log(p), spelled) - np.log(len(logs)) - np.log(STRENGTH + total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(word_classes(lengths, data).astype(np.int16)), batch.column(1), pa.array(logp / np.log(10))], names=["word", "class", "c", "logp"])

    return vocabulary.mapInArrow(run, "word binary, class short, c long, logp double")


def scored(docs: DataFrame, held_out, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score, perplexity) of every row.

    ``held_out``: boolean column; the model learns from the other rows.
    """
    with worker_env(docs.sparkSession, _WORKER_ENV):
        return _scored(docs, held_out, burn_in, samples)


def _scored(docs: DataFrame, held_out, burn_in: int, samples: int) -> DataFrame:
    spark = docs.sparkSession
    parts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(_blocks, _PART), "lm-blocks", "kind")
    asked = parts.where(F.col("kind") == _WORDS).select("block", "ref", "word", "seen")
    vocabulary = stored(asked.groupBy("word").agg(F.sum("seen").alias("c")), "lm-words")
    one = lambda n: F.count_if(F.col("c") == n)
    got = vocabulary.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), one(1).alias("n1"), one(2).alias("n2")).first()
    total, distinct = got["n"] or 0, got["v"]
    discount = min(0.95, max(0.05, got["n1"] / max(1, got["n1"] + 2 * got["n2"])))
    kept = sweeps(vocabulary, discount, distinct, burn_in, samples)
    words = stored(probabilities(vocabulary, kept, discount, total), "lm-scores")
    discard(vocabulary)
    left_over = np.mean([(STRENGTH + discount * tables) * (1 - spelled) for tables, _, spelled in kept]) / (STRENGTH + total)
    base = np.zeros(CLASSES)
    for r in words.where("c > 0").groupBy("class").agg(F.sum(F.pow(F.lit(10.0), "logp")).alias("p")).collect():  # a row a class
        base[r["class"]] = r["p"]
    base[UNKNOWN] = max(left_over, 1e-12)
    unknown = float(np.log10(base[UNKNOWN]))
    ratios = spark.sparkContext.broadcast(context_ratios(*class_bigrams(parts), base / base.sum(), burn_in, samples))  # CLASSES squared numbers
    met = asked.select("block", "ref", "word").join(words, "word").select("block", "ref", "class", "c", "logp", F.xxhash64("word").alias("h"))
    answers = stored(met.mapInArrow(_packed_answers, _ANSWER), "lm-answers")
    # Words are answered: from here on there are their numbers only.
    discard(words)
    discard(parts, f"kind={_WORDS}")
    buckets = max(1, -(-total // BUCKET_TOKENS))

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        ratio, (c, logp, ids) = ratios.value, answers_of(right)
        # Words in order of their ids. Those that were not learned are one word, except as contexts.
        kind = ids >> _ID_BITS
        ids = np.where(c > 0, ids, UNKNOWN << _ID_BITS)
        order = ids.argsort(kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        c, logp, kind, ids = (x[order] for x in (c, logp, kind, ids))
        closed = np.where(c > 0, logp, unknown)
        refs = [place[unpacked(x.as_py())] for x in left.column("refs")]
        n, r = np.array([len(x) for x in refs]), np.concatenate([np.zeros(0, np.int32), *refs])
        del refs
        before, doc = np.full(len(r), place_of_end(kind), np.int32), np.repeat(np.arange(len(n), dtype=np.int32), n)
        before[1:] = r[:-1]
        own = np.stack([c > 0, np.log10((c + 1) / (total + distinct + 1)), logp - closed])
        sums, open_class = np.zeros((4, len(n))), np.where(c > 0, kind, UNKNOWN)
        for i in range(0, len(r), _STRETCH):
            rs, ds, us = r[i : i + _STRETCH], doc[i : i + _STRETCH], before[i : i + _STRETCH]
            for k in range(3):
                sums[k] += np.bincount(ds, own[k][rs], len(n))
            # Words after a word that was not learned have no restaurant but the class's.
            lone = np.flatnonzero(c[us] == 0)
            sums[3] += np.bincount(ds[lone], closed[rs[lone]] + ratio[kind[us[lone]], open_class[rs[lone]]], len(n))
        one = np.where(c > 0, np.arange(len(c)), (c > 0).argmin() if len(c) else 0).astype(np.int32)
        block = left.column("of")[0].as_py() if left.num_rows else 0
        met = (c > 0)[before]
        before, r, doc = before[met], one[r[met]], doc[met]
        del met
        rows = pack_contexts(before, r, doc, ~np.asarray(left.column("held_out")), ids, c, closed, buckets)
        at = (np.arange(len(n)) + block) % buckets
        docs_of = [{"part": int(at[i]), "block": block, "doc": i, "doc_id": d, "held_out": o, "n": int(n[i]), "sums": sums[:, i].tobytes()} for i, (d, o) in enumerate(zip(left.column("doc_id").to_pylist(), left.column("held_out").to_pylist(), strict=True))]
        return pa.Table.from_pylist(docs_of + [{"block": block, **x} for x in rows], _DEALT_TYPE)

    def seated(group: pa.Table) -> pa.Table:
        whole = group.select(_SUM_COLUMNS).filter(pc.is_valid(group.column("doc")))
        block, at = group.column("block").to_numpy(), np.flatnonzero(pc.is_null(group.column("doc")).to_numpy())
        packs = [{"block": int(block[i]), "part": group.column("part")[i].as_py(), **{x: group.column(x)[i].as_buffer() for x in _PACKED[1:]}} for i in at[block[at].argsort(kind="stable")].tolist()]
        sums = context_sums(packs, ratios.value, burn_in, samples)
        return pa.concat_tables([whole.cast(_SUM_TYPE), pa.Table.from_pylist(sums, _SUM_TYPE)])

    def added(group: pa.Table) -> pa.Table:
        docs_of = group.filter(pc.is_valid(group.column("doc")))
        i, n = docs_of.column("doc").to_numpy(), docs_of.column("n").to_numpy()
        own = np.frombuffer(b"".join(docs_of.column("sums").to_pylist()), np.float64).reshape(-1, 4)
        scores = np.zeros(int(i.max()) + 1)
        scores[i] = own[:, 3]
        parts_of = group.filter(pc.is_null(group.column("doc")))
        for x in parts_of.column("sums").take(pa.array(parts_of.column("n").to_numpy().argsort(kind="stable"))):
            more = np.frombuffer(zlib.decompress(x.as_py()), np.float32)
            scores[: len(more)] += more
        scores = scores[i]
        return pa.table(
            [docs_of.column("doc_id"), docs_of.column("held_out"), pa.array(n), pa.array(own[:, 0].astype(np.int64)), pa.array(np.full(len(n), total)), pa.array(own[:, 1]), pa.array(scores), pa.array(scores + own[:, 2]), pa.array(10 ** np.minimum(300, -scores / n))], names=[x.split()[0] for x in schema.split(", ")]
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, spelled_score double, perplexity double"
    rows = parts.where(F.col("kind") == _DOCS).select(F.col("block").alias("of"), "doc_id", "held_out", "refs")
    dealt = stored(rows.groupBy("of").cogroup(answers.groupBy("block")).applyInArrow(deal, _DEALT), "lm-pairs")
    discard(answers)
    discard(parts, f"kind={_DOCS}")
    return dealt.groupBy("part").applyInArrow(seated, _SUMS).groupBy("block").applyInArrow(added, schema)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), in_fold(2, 7))
