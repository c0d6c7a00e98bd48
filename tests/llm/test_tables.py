import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexigrid.llm import ann, mixing, sharding, winnow

WORD = r"[^\x20\x09-\x0D]+"


def test_mixing_targets_and_copies(spark, put, awkward, docs_rows):
    folder = put(documents=awkward)
    out = mixing.op1_mix_sources(spark, folder).collect()
    assert len(out) == len(docs_rows)
    size = Counter()
    for r in docs_rows:
        size[r[3]] += len(re.findall(WORD, r[1] or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
            open_.discard(s)
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    for s in names:
        assert abs(taken[s] - target[s]) <= max(2, 0.02 * target[s])
    again = mixing.op1_mix_sources(spark, folder).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in out) == Counter((r["doc_id"], r["taken"]) for r in again)


def test_mixing_repeats_rows(awkward, empty, with_null_id):
    # Rows are told apart by a hash here, so other rows of a cell may get its copies; the words taken agree.
    want, got = Counter(), Counter()
    for r in mixing.mixed(awkward).collect():
        want[r["source"]] += r["copies"] * r["size"]
    out = mixing.repeat_by_copies(awkward)
    assert out.columns == awkward.columns
    for r in out.collect():
        got[r["source"]] += len(re.findall(WORD, r["text"]))
    assert got == want
    assert mixing.repeat_by_copies(empty).count() == 0 == mixing.mixed(empty).count()
    assert mixing.mixed(with_null_id).count() == with_null_id.count()


def test_sharding_law(spark, put, awkward, docs_rows, empty, with_null_id):
    out = sharding.op5_sharding(spark, put(documents=awkward)).collect()
    assert len(out) == len(docs_rows)
    want = Counter((r[0], len((r[1] or "").encode()) + (1), zlib.crc32((r[1] or "").encode())) for r in docs_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots, fill = defaultdict(list), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        fill[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(empty).count() == 0
    assert sharding.sharded(with_null_id).count() == with_null_id.count()


def test_sharding_many_small_rows_and_one_hot_text(spark):
    many = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    out = sharding.sharded(many, 4)
    fill = {r["shard"]: r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert max(fill.values()) < 1.03 * sum(fill.values()) / 4 and len(fill) == 4
    same = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("row").alias("text")).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("x")
    assert sharding.sharded(same, 4).select("shard", "slot").distinct().count() == 500




def test_winnowing_query(spark, put, awkward, docs_rows, empty, with_null_id):
    import hashlib

    out = winnow.op6_winnowing(spark, put(documents=awkward)).collect()
    assert len(out) == len(docs_rows)
    prints = defaultdict(set)
    text = {r[0]: r[1] or "" for r in docs_rows}
    order = sorted(text)
    for r in out:
        prints[text[r["doc_id"]]].add(r["fingerprint"])
        assert r["n_chars"] == len(text[r["doc_id"]]) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values())
    single = {d for d, n in Counter(r[0] for r in docs_rows).items() if n == 1}
    for r in out:
        i = order.index(r["doc_id"])
        if r["doc_id"] in single:
            own, following = text[r["doc_id"]], text[order[(i + 1) % len(order)]]
            half = len(own) // 2
            assert r["edited_sha256"] == hashlib.sha256((own[: len(own) - half] + following[:half]).encode()).hexdigest()
    assert winnow.fingerprinted(empty).count() == 0
    assert winnow.fingerprinted(with_null_id).count() == with_null_id.count()


def test_winnowing_positions_and_guarantee(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(["a", "b"] + base[20:27] + ["c"]), "one two", "", "same " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = {r["i"]: r["p"] for r in winnow.selected(df, "text", "s").select("i", winnow.positions(F.col("s")).alias("p")).collect()}
    hashes = {i: {p["hash"] for p in ps} for i, ps in rows.items()}
    assert hashes[0] & hashes[1], "seven shared words are found"
    assert rows[3] == [] and len(rows[2]) == 1
    assert all(0 <= p["position"] <= 56 for p in rows[0])
    assert len(hashes[4]) == 1 and rows[4][0]["position"] == 3, "of equal minima the rightmost of each window"


def test_ann_recall_ties_and_odd_vectors(spark, put):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 12)).astype("float32")
    x[300:500] = x[7]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(1200)]
    odd = [(5000, None, 0), (5100, [0.0] * 12, 0), (5200, [float("nan")] * 12, 0), (5300, [None] * 12, 0), (5400, [1.0], 0), (None, [1.0] * 12, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("list", F.lit(2))
    out = ann.op10_ann_search(spark, put(embeddings=df)).collect()
    by = defaultdict(dict)
    for r in out:
        by[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    y = x.astype(float)
    hit = total = 0
    for q in range(0, 1200, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1200), d))[:10]
        assert sorted(by[q]) == list(range(1, 11))
        hit += len({v for v, _ in by[q].values()} & set(best.tolist()))
        total += 10
        assert all(s == pytest.approx(d[v], rel=1e-12) for v, s in by[q].values())
    assert set(by) == set(range(0, 1200, 100)) and hit / total >= 0.9
    assert [by[300][k][0] for k in range(1, 11)] == [7, *range(301, 310)], "ties go to the smaller id"
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ann.op10_ann_search(spark, put(embeddings=none)).count() == 0
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, label int")
    assert ann.op10_ann_search(spark, put(embeddings=few)).count() == 3


def test_repeats_of_a_row_share_copies_and_near_equal_rows_keep_theirs(spark):
    from lexigrid.llm import mixing

    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "fr", "s", 5)] + [(2, "d e", "en", "s", 3)] * 200 + [(3, "f", "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.repeat_by_copies(docs, (1.0,), 2.0, 2)
    assert out.columns == docs.columns
    got = {(r["doc_id"], r["lang"]): r["count"] for r in out.groupBy("doc_id", "lang").count().collect()}
    assert got == {(1, "en"): 2, (1, "fr"): 2, (2, "en"): 400, (3, "en"): 2}


def _brute_neighbours(y, ids, q, k=10):
    d = ((y - y[q]) ** 2).sum(1) ** 0.5
    d[q] = float("inf")
    return sorted(range(len(y)), key=lambda j: (d[j], ids[j]))[:k], d


def test_ann_recall_with_many_lists(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ann, "LIST", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 16)) * 3
    x = (centres[rng.integers(0, 150, 6000)] + rng.normal(size=(6000, 16))).astype("float32")
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(6000)], "vec_id long, embedding array<float>")
    found = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    y, hit = x.astype(float), 0
    for q in range(0, 6000, 100):
        hit += len(found[q] & set(_brute_neighbours(y, range(6000), q)[0]))
    assert len(found) == 60 and hit >= 0.9 * 600
    index = ann.learn(y, 150)
    ids, d = index.nearest(y[:50])
    read = ((np.sqrt(d) <= ann.SEARCH_RATIO * np.sqrt(d[:, :1])) | (np.arange(d.shape[1]) < ann.LEAST_LISTS)).sum(1)
    assert len(index.centroids) >= 100 and read.mean() < 0.5 * len(index.centroids), "lists are left out"


def test_ann_repeated_rows_and_widening(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 1)
    monkeypatch.setattr(ann, "LEAST_LISTS", 1)
    rows = [(i, [float(10**i), 1.0]) for i in range(5)] + [(3, [1000.0, 1.0])] * 2
    out = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect():
        out[r["query_id"]].append(r["vec_id"])
    assert out == {0: [1, 2, 3, 3, 3, 4]}
    twice = ann.search(spark.createDataFrame(rows[:2] * 2, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert sorted((r["rank"], r["vec_id"]) for r in twice.collect()) == [(1, 0), (1, 0), (2, 1), (2, 1), (3, 1), (3, 1)]


def test_winnowing_against_brute_force(spark, put, docs_rows, awkward):
    def chosen(text):
        tokens = re.findall(r"[^\x20\x09-\x0D]{1,32}", text)
        grams = [tuple(tokens[i : i + winnow.K]) for i in range(len(tokens) - winnow.K + 1)] or ([tuple(tokens)] if tokens else [])
        return grams

    texts = {r[0]: r[1] or "" for r in docs_rows}
    grams = sorted({g for t in texts.values() for g in chosen(t)})
    df = spark.createDataFrame([(i, " ".join(g)) for i, g in enumerate(grams)], "i int, text string")
    value = {grams[r["i"]]: r["h"][0] for r in df.select("i", "text").transform(lambda d: winnow.selected(d, "text", "s")).select("i", winnow.hashes(F.col("s")).alias("h")).collect()}

    def fingerprint(text):
        """Minima of windows of W grams, the rightmost of equal ones."""
        own = [value[g] for g in chosen(text)]
        picked = set()
        for i in range(max(1, len(own) - winnow.W + 1) if own else 0):
            picked.add(min(own[i : i + winnow.W]))
        return picked

    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    order = sorted(texts)
    got = {r["doc_id"]: r for r in winnow.op6_winnowing(spark, put(documents=awkward)).collect()}
    counts = Counter(r[0] for r in docs_rows)
    prints = defaultdict(set)
    for i, d in enumerate(order):
        own, following = fingerprint(texts[d]), fingerprint(texts[order[(i + 1) % len(order)]])
        prints[frozenset(own)].add(got[d]["fingerprint"])
        if counts[d] == 1:
            assert got[d]["near_next"] == pytest.approx(like(own, following)), d
    assert all(len(p) == 1 for p in prints.values()) and len({x for p in prints.values() for x in p}) == len(prints)
