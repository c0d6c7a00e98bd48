"""BPE encoding and decoding by dynamic programming over prefixes.

For a word, exactly one token can be last in the encoding of each prefix. It is found among the
vocabulary entries that end there: an automaton over all entries (trie with suffix links) yields them,
longest first, and an entry fits if the encoding of what stands before it ends in a token that stays
apart from it. Two tokens stay apart if merging their symbols, by rank, brings both back (checked once
per pair). The encoding of the word follows from the back-pointers. No merge loop runs over the text.

The file says how texts are split: NFC, runs of white space to one space, lower case, a pattern for
words, bytes as printable characters, and a mark at each word's end. Special tokens are matched in the
text as it stands. Null texts are empty and have no tokens. Rows are encoded one by one: a null doc_id stays null,
repeated rows get equal results, further columns play no part.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table

#: Words whose encoding a worker remembers; beyond that it forgets all and starts anew.
CACHE_WORDS = 3 << 16
#: Characters of words a worker remembers: a single longer word is encoded each time.
CACHE_CHARS = 1 << 23
#: Pairs of tokens it remembers.
CACHE_PAIRS = 1 << 18


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class WordBpe:
    """Encoder and decoder of one vocabulary file with a mark at the end of words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of.update({i: t for t, i in self.special.items()})
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.chars = byte_characters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        # An entry can be a token of an encoding only if merging its own symbols gives it back.
        self.automaton = ahocorasick.Automaton()
        self.symbols: dict[int, int] = {}
        for token, i in self.vocab.items():
            if self._merged(self._symbols(token)) == [token]:
                self.automaton.add_word(token.removesuffix(self.end) + "\n" if token.endswith(self.end) and token != self.end else token, (self._length(token), i))
        self.automaton.make_automaton()
        self.apart: dict[int, bool] = {}
        self.words: dict[str, tuple[bytes, str, int]] = {}
        self.held = 0

    def _length(self, token: str) -> int:
        return len(token) - len(self.end) + 1 if token.endswith(self.end) and token != self.end else len(token)

    def _symbols(self, word: str) -> list[str]:
        """Single characters; the last one carries the word's end."""
        if word.endswith(self.end) and word != self.end:
            body = word.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return list(word)

    def _merged(self, symbols: list[str]) -> list[str]:
        """What merging by rank makes of a few symbols; used on single entries and pairs of them."""
        s = list(symbols)
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda i: self.rank.get((s[i], s[i + 1]), 1 << 60))
            if (s[best], s[best + 1]) not in self.rank:
                break
            s[best : best + 2] = [s[best] + s[best + 1]]
        return s

    def _stay_apart(self, a: int, b: int) -> bool:
        if len(self.apart) >= CACHE_PAIRS:
            self.apart.clear()
        s, t = self.text_of[a], self.text_of[b]
        found = self.apart[a << 20 | b] = self._merged([*self._symbols(s), *self._symbols(t)]) == [s, t]
        return found

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word of byte characters, without its end mark."""
        n = len(word)
        # A line feed stands for the end mark, so that a token of the last character reaches one further.
        # What ends at the last character without the mark is not a token of this word.
        last, came = [-1] * (n + 2), [0] * (n + 2)
        apart = self.apart
        for at, (length, i) in self.automaton.iter(word + "\n"):
            end = at + 1
            if end == n or last[end] >= 0:
                continue
            before = end - length
            if before:
                left = last[before]
                if left < 0:
                    continue
                fits = apart.get(left << 20 | i)
                if not (self._stay_apart(left, i) if fits is None else fits):
                    continue
            last[end], came[end] = i, before
        out, at = [], n + 1
        while at > 0:
            if last[at] < 0:
                raise ValueError("the vocabulary does not cover this word")
            out.append(last[at])
            at = came[at]
        return out[::-1]

    def _word(self, word: str) -> tuple[bytes, str, int]:
        ids = self.word_ids("".join(map(self.chars.__getitem__, word.encode())))
        found = (b"".join(i.to_bytes(4, "little") for i in ids), "".join(" " + self.text_of[i] for i in ids), len(ids))
        self.held += len(word)
        if len(self.words) >= CACHE_WORDS or self.held > CACHE_CHARS:
            self.words.clear()
            self.held = len(word)
        if len(word) <= CACHE_CHARS:
            self.words[word] = found
        return found

    def _split(self, text: str) -> Iterator[tuple[str, int | None]]:
        if self.split_special is None or not any(map(text.__contains__, self.special)):
            yield text, None
            return
        for part in self.split_special.split(text):
            if part:
                yield part, self.special.get(part)

    def encode_packed(self, text: str | None) -> tuple[bytes, str, int]:
        """Ids as little-endian 32-bit integers, the decoded text, and the number of ids."""
        ids, texts, n = [], [], 0
        words = self.words
        for part, special in self._split(text or ""):
            if special is not None:
                ids.append(special.to_bytes(4, "little"))
                texts.append(" " + part)
                n += 1
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            for w in self.pattern.findall(self.prepared(part)):
                a, b, k = words.get(w) or self._word(w)
                ids.append(a)
                texts.append(b)
                n += k
        return b"".join(ids), "".join(texts)[1:], n

    def prepared(self, part: str) -> str:
        return lowered(part)

    def encode(self, text: str | None) -> list[int]:
        packed = self.encode_packed(text)[0]
        return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as for a file that names no decoder."""
        return " ".join(self.text_of[i] for i in ids if i in self.text_of)


def lowered(text: str) -> str:
    """Lower case, each character by itself: a final sigma is not treated apart."""
    if "Σ" in text:
        return "".join(c.lower() for c in text)
    return text.lower()


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def forget(path: str) -> None:
    """Give a vocabulary and its caches back to the machine: the worker may go on to other work."""
    _LOADED.pop(path, None)
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, path: str | None = None, ids: bool = False, keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ``ids`` also ids array<int> and decoded string.

    ``path``: vocabulary file, present on every machine. Order and number of rows stay as they are. Workers
    ``keep`` what they have learned for their next task, which saves time and takes memory.
    """
    path = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [bpe.encode_packed(x.as_py()) for x in part.column(1)]
                out = [
                    part.column(0),
                    pa.array([n for _, _, n in rows], pa.int64()),
                    pa.array([hashlib.sha256(a).hexdigest() for a, _, _ in rows]),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for _, b, _ in rows]),
                ]
                if ids:
                    import numpy as np

                    out += [pa.array([np.frombuffer(a, "<i4") for a, _, _ in rows], pa.list_(pa.int32())), pa.array([b for _, b, _ in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in schema.split(", ")])
        if not keep:
            del bpe
            forget(path)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
