import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexigrid.llm import bpe, hpylm, langid, quality
from lexigrid.llm._fold import in_fold


def test_bpe_agrees_with_the_library(spark, put, awkward, docs_rows, empty):
    import hashlib

    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.loaded(bpe.default_path())
    rnd = random.Random(4)
    pool = "aeiouthnrs '’.,!?-ÉéßΣσİıK12३́ͅ \n\t\x85 <|>/w日ｶ😀"
    texts = ["", None, "It's 's <|endoftext|>X", "ΟΔΥΣΣΕΥΣ", "x" * 4000, "</w> a</w>b"] + ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 50))) for _ in range(300)]
    for t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.encode_packed(t)[1] == lib.decode(ids, skip_special_tokens=False) == own.decode(ids)
    out = bpe.op7_bpe_roundtrip(spark, put(documents=awkward)).collect()
    want = Counter()
    for r in docs_rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == want
    assert bpe.encode_decode(empty, ids=True).count() == 0


def test_lm_counts_and_base_score(spark, put, awkward, docs_rows, empty, with_null_id):
    rows = hpylm.op2_lm_scoring(spark, put(documents=awkward)).collect()
    tok = [(r[0], zlib.crc32(str(r[0]).encode()) % 7 == 2, re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower()) + [b""]) for r in docs_rows]
    c = Counter()
    for _, h, t in tok:
        if not h:
            c.update(t)
    n, v = sum(c.values()), len(c)
    want = {d: (h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for d, h, t in tok}
    assert len(rows) == len(docs_rows)
    for r in rows:
        h, size, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, size, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0 and math.isfinite(r["score"])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert hpylm.scored(empty, in_fold(2, 7)).count() == 0
    assert hpylm.scored(with_null_id, in_fold(2, 7)).count() == with_null_id.count()


def _seatings(n, d):
    """Weight of all seatings of n customers by their number of tables, one customer after another."""
    ways = {(1,): 1.0}
    for _ in range(n - 1):
        more = Counter()
        for tables, w in ways.items():
            more[tuple(sorted((*tables, 1)))] += w
            for i, k in enumerate(tables):
                more[tuple(sorted((*tables[:i], k + 1, *tables[i + 1 :])))] += w * (k - d)
        ways = more
    out = Counter()
    for tables, w in ways.items():
        out[len(tables)] += w
    return out


def test_lm_tables_are_drawn_from_all_seatings():
    d, mass, p, n, many = 0.4, 3.0, 0.15, 6, 40000
    want = {t: w * p**t * math.prod(mass + d * j for j in range(t)) for t, w in _seatings(n, d).items()}
    keys = np.random.default_rng(1).integers(0, 2**63, many).astype(np.uint64)
    got = Counter(hpylm.seat(np.full(many, n), np.full(many, mass), np.full(many, p), d, keys).astype(int).tolist())
    for t, w in want.items():
        share = w / sum(want.values())
        assert abs(got[t] / many - share) < 5 * math.sqrt(share * (1 - share) / many) + 1e-4


def test_lm_seating_and_spelling_are_proper():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 5, 80, 1000])
    t = np.mean([hpylm.seat(c, np.full(6, 3.0), np.full(6, 0.5), 0.5, rng.integers(0, 2**63, 6).astype(np.uint64)) for _ in range(300)], axis=0)
    assert t[0] == 0 and t[1] == 1 and (np.diff(t) > 0).all() and (t <= c).all()
    lengths, data = np.array([2, 1, 0]), np.frombuffer(b"aba", np.uint8)
    context, symbol, first = hpylm.symbols(lengths, data)
    assert symbol.tolist() == [97, 98, 256, 97, 256, 256] and first.tolist() == [0, 3, 5]
    keys, at = np.unique(context * hpylm.SYMBOLS + symbol, return_inverse=True)
    s = hpylm.sample_spelling(keys, np.bincount(at, np.full(len(symbol), 40)).astype(np.int64), hpylm.uniform_spelling(), 1)
    assert np.allclose(s.two.sum(1), 1, atol=1e-4) and np.allclose(s.one.sum(1), 1, atol=1e-4)
    assert s.log_probability(lengths, data)[0] > hpylm.uniform_spelling().log_probability(lengths, data)[0]
    assert hpylm.unpacked(hpylm.packed(np.array([0, 1, 300, 70000]))).tolist() == [0, 1, 300, 70000]


def test_lm_contexts_are_distributions():
    rng = np.random.default_rng(3)
    base = rng.random(hpylm.CLASSES)
    base /= base.sum()
    keys = np.unique(rng.integers(0, 20 * hpylm.CLASSES, 3000))
    r = hpylm.context_ratios(keys, rng.integers(1, 200, len(keys)), base, 1, 2)
    assert np.allclose((10.0**r * base).sum(1), 1, atol=1e-3)
    assert r[keys[0] // hpylm.CLASSES, keys[0] % hpylm.CLASSES] > 0


def test_lm_word_order_counts_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(hpylm, "BLOCK_TOKENS", 2000)
    rnd = random.Random(2)
    kinds = [[f"{a}{i}{end}" for i in range(40) for a in "xy"] for end in ("ing", "eur", "ung", "are")]
    rows = []
    for i in range(400):
        # Words of four kinds follow one another in turn.
        w = [rnd.choice(kinds[j % 4]) for j in range(rnd.randint(20, 60))]
        rows.append((i, " ".join(w)))
        rows.append((10_000 + i, " ".join(sorted(w))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    other = F.col("doc_id") >= 10_000
    found = {r["doc_id"]: r for r in hpylm.scored(df, other).collect()}
    ordered, mixed_up = (sum(found[k + i]["score"] for i in range(400)) for k in (0, 10_000))
    assert ordered > 0.7 * mixed_up and ordered > 0.8 * sum(found[i]["base_score"] for i in range(400))
    again = {r["doc_id"]: r["score"] for r in hpylm.scored(df.repartition(7, "text"), other).collect()}
    assert all(found[i]["score"] == pytest.approx(again[i], rel=1e-6) for i in found)


def test_lm_answers_keep_their_places_when_packed():
    rng = np.random.default_rng(6)
    block, ref = np.repeat([7, 9], 500), np.r_[rng.permutation(500), rng.permutation(500)].astype(np.int32)
    kind, c, logp, h = rng.integers(0, hpylm.CLASSES, 1000).astype(np.int16), rng.integers(0, 90000, 1000), -rng.random(1000), rng.integers(-(2**63), 2**63, 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (block, ref, kind, c, logp, h)], names=["block", "ref", "class", "c", "logp", "h"])
    packs = pa.Table.from_batches([x for half in (batch.slice(0, 300), batch.slice(300)) for x in hpylm._packed_answers(iter([half]))])
    for b in (7, 9):
        own = np.flatnonzero(block == b)[ref[block == b].argsort()]
        got_c, got_logp, ids = hpylm.answers_of(packs.filter(pa.compute.equal(packs["block"], b)))
        assert (got_c == c[own]).all() and np.allclose(got_logp, logp[own], atol=1e-6)
        assert (ids >> hpylm._ID_BITS == kind[own]).all() and len(set(ids.tolist())) == 500
    ids = np.unique(rng.integers(0, 2**56, 300))
    assert (hpylm.unpacked_ids(hpylm.packed_ids(ids)) == ids).all()


def test_lm_holds_no_table_that_it_is_done_with(spark):
    from pathlib import Path

    from lexigrid.session import shared_dir

    held = lambda: {f for f in Path(shared_dir(spark).removeprefix("file://")).rglob("lm-*/**/*.parquet")}
    before = held()
    found = hpylm.scored(spark.createDataFrame([(i, f"a b{i % 3} c") for i in range(50)], "doc_id long, text string"), F.col("doc_id") > 40)
    left = held() - before
    assert {str(f).split("/lm-")[1].split("-")[0] for f in left} == {"blocks", "pairs"} and all("kind=2" in str(f) or "lm-pairs" in str(f) for f in left)
    assert found.count() == 50


def test_lm_contexts_are_words_not_classes(spark, monkeypatch):
    # All words are of one class; each is followed by the next one.
    rnd = random.Random(9)
    rows = []
    for i in range(200):
        at = rnd.randrange(50)
        w = [f"w{(at + j) % 50}ing" for j in range(30)]
        rows += [(i, " ".join(w)), (1000 + i, " ".join(sorted(w, key=lambda _: rnd.random())))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    other = (F.col("doc_id") >= 1000) | (F.col("doc_id") % 5 == 0)
    found = {r["doc_id"]: r["score"] for r in hpylm.scored(df, other).collect()}
    held = range(0, 200, 5)
    assert sum(found[i] for i in held) > 0.3 * sum(found[1000 + i] for i in held)
    monkeypatch.setattr(hpylm, "BUCKET_TOKENS", 60)
    parts = {r["doc_id"]: r["score"] for r in hpylm.scored(df, other).collect()}
    assert all(parts[i] == pytest.approx(found[i], rel=0.25) for i in held)


def test_lm_seating_holds_pairs_not_occurrences():
    import tracemalloc

    rng = np.random.default_rng(4)
    words, n, rows = 100, 200_000, 8
    flat = np.zeros((hpylm.CLASSES, hpylm.CLASSES), np.float32)
    ids, c, logp = np.sort(rng.choice(2**56, words, replace=False)), np.full(words, rows * n // words), np.log10(np.full(words, 1 / words))
    packs = []
    for block in range(rows):
        before, r, doc = rng.integers(0, words, n).astype(np.int32), rng.integers(0, words // 10, n).astype(np.int32), np.sort(rng.integers(0, 500, n)).astype(np.int32)
        packs += [{"block": block, **x} for x in hpylm.pack_contexts(before, r, doc, np.ones(500, bool), ids, c, logp, 1)]
    assert len(packs) == rows
    tracemalloc.start()
    found = hpylm.context_sums(packs, flat, 1, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sums = np.stack([np.frombuffer(zlib.decompress(x["sums"]), "<f4") for x in found])
    # Each word is as likely as the others of its context, of which there are a tenth.
    assert sums.shape == (rows, 500) and sums.sum() == pytest.approx(-math.log10(words // 10) * rows * n, rel=0.05)
    assert peak < 5 * rows * n


def _sentences(n, kind, seed):
    rnd = random.Random(seed)
    parts = {"aa": ["thon", "ing", "the", "ed"], "bb": ["été", "eux", "que", "oi"], "cc": ["ung", "sch", "ß", "der"]}[kind]
    return [" ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(3, 60))) for _ in range(n)]


def test_language_id_on_held_out_rows(spark, put, empty):
    rows = [(i, t, k, "s", len(t)) for j, k in enumerate(("aa", "bb", "cc")) for i, t in enumerate(_sentences(60, k, j), 1000 * j)]
    odd = [(9001, None, "aa", None, 0), (9002, "12 34 ...", "aa", "s", 9), (9003, "", None, "s", 0), (9004, "thon the " * 5000, None, "s", 45000)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in langid.op4_language_id(spark, put(documents=df)).collect()}
    assert len(out) == len(rows) + len(odd)
    held = [(out[i], k) for i, _, k, _, _ in rows if out[i]["held_out"]]
    assert held and sum(r["lang_pred"] == k for r, k in held) >= 0.95 * len(held)
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in out)
    assert [out[i]["lang_pred"] for i in (9001, 9002, 9003, 9004)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.op4_language_id(spark, put(documents=empty)).count() == 0


def test_language_gradient_descends():
    m = langid.fit(_sentences(30, "aa", 1) + _sentences(30, "bb", 2), ["aa"] * 30 + ["bb"] * 30)
    raw = np.frombuffer(_sentences(1, "bb", 9)[0].encode(), np.uint8)
    x, _, _ = langid.windows(raw, np.array([0, len(raw)]))
    assert langid.probabilities(m, x).mean(0).argmax() == 1
    a, top, _ = langid.forward(m, x)
    assert np.allclose(a, langid.probabilities(m, x), atol=1e-5) and np.isfinite(top).all()


def test_quality_on_held_out_rows(spark, put, empty, awkward):
    good, bad = _sentences(150, "aa", 3), [" ".join(w + "###" for w in t.split()) for t in _sentences(150, "bb", 4)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(0, 1, 0), (777, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    folder = put(documents=df, labels=labels)
    out = {r["doc_id"]: r for r in quality.op9_quality_classifier(spark, folder).collect()}
    held = [r for i, r in out.items() if r["held_out"] and i < 300]
    assert len(out) == len(rows) and sum(r["predicted"] == int(r["doc_id"] < 150) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    kept = quality.keep_good(awkward, labels)
    assert kept.columns == awkward.columns
    assert quality.keep_good(empty, labels).count() == 0
    assert quality.keep_good(df, labels.limit(0)).count() == df.count(), "without labels nothing is rejected"


def test_rows_without_an_id_and_repeated_rows_in_every_model(spark, put, with_null_id, awkward):
    folder = put(documents=with_null_id.unionByName(awkward.select(*with_null_id.columns)), labels=spark.createDataFrame([(3, 1, 0), (6, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for run in (bpe.op7_bpe_roundtrip, langid.op4_language_id, quality.op9_quality_classifier):
        rows = run(spark, folder).collect()
        assert len(rows) == docs.count() and sum(r["doc_id"] is None for r in rows) == docs.where("doc_id IS NULL").count()
        per = Counter(r["doc_id"] for r in rows)
        assert all(len({tuple(r) for r in rows if r["doc_id"] == d}) == 1 for d, n in per.items() if n > 1 and d is not None)


def test_languages_without_a_cap_and_long_texts_only(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 40, f"l{i:03d}") for i in range(300)]
    rows += [(1000 + i, "wörd über " * 4000, "long") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = docs.where(~in_fold()).select("lang").distinct().count()
    m = langid.learn(docs.where("doc_id % 10 < 3 OR doc_id >= 1000"))
    assert "long" in m.languages and len(m.languages) < learned
    found = langid.predict(docs.where("doc_id >= 1000"), m).collect()
    assert sum(r["lang_pred"] == "long" for r in found) >= 10
