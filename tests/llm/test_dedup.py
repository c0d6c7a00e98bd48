import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from lexigrid.llm import nearcopy, simhash, substring

WORD = r"[^\x20\x09-\x0D]+"


def brute_fingerprint(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, d=4):
    """Label of each place: the least place reachable."""
    label = list(range(len(fps)))
    for _ in fps:
        new = [min(label[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= d) for i in range(len(fps))]
        if new == label:
            return label
        label = new
    return label


def test_simhash_against_brute_force(docs, docs_rows):
    got = {(r["doc_id"], r["fp"] % (1 << 64)): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(r[1]) for r in docs_rows]
    label = brute_components(fps)
    for i, r in enumerate(docs_rows):
        least = min(docs_rows[j][0] for j in range(len(fps)) if label[j] == label[i])
        assert got[r[0], fps[i]] == least


def test_simhash_query_and_edge_tables(spark, put, awkward, empty, with_null_id):
    out = simhash.op3_simhash_neardup(spark, put(documents=awkward))
    assert out.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[100]["fingerprint"] == "0" * 16 == rows[101]["fingerprint"]
    assert rows[100]["component_id"] == rows[101]["component_id"]
    assert simhash.op3_simhash_neardup(spark, put(documents=empty)).count() == 0
    assert simhash.near_duplicates(with_null_id).count() == with_null_id.count()


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_copies_against_brute_force(awkward, docs_rows):
    root = {}
    for r in nearcopy.near_copies(awkward).collect():
        root[r["doc_id"]] = r["root"]
    sets = [shingles(r[1]) for r in docs_rows]
    n = len(sets)
    label = list(range(n))
    for _ in range(n):
        label = [min(label[j] for j in range(n) if likeness(sets[i], sets[j]) >= 0.8) for i in range(n)]
    want, got = label, [root[r[0]] for r in docs_rows]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got)) < n


def test_wide_fingerprints_meet_at_the_similarity():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(2, 8)))
    hit = total = 0
    for _ in range(300):
        a = [word() for _ in range(rnd.randint(60, 300))]
        b = a[: int(len(a) * 0.82)]
        if likeness(shingles(" ".join(a)), shingles(" ".join(b))) < 0.8:
            continue
        keys = [set(nearcopy.keys_of(*[x[None] for x in nearcopy.wide_simhash(" ".join(t))]).ravel().tolist()) for t in (a, b)]
        hit += bool(keys[0] & keys[1])
        total += 1
    assert total > 200 and hit >= 0.9 * total


def test_partners_are_the_nearest(spark):
    rng = np.random.default_rng(2)
    f = rng.integers(0, 2**63, (6, 4), dtype=np.uint64)
    f[1], f[2], f[3] = f[0] ^ np.uint64(1), f[0] ^ np.uint64(7), f[0] ^ np.uint64(1 << 40)
    assert not any(map(len, nearcopy.nearest_of(f[[0, 5], 0][None])))
    a, b, further = nearcopy.nearest_of(f[:3, 0][None])
    assert list(zip(a, b)) == [(f[0, 0], f[1, 0]), (f[1, 0], f[0, 0]), (f[2, 0], f[1, 0])] and set(further) == set(f[:3, 0])
    assert nearcopy.nearest_apart(f[:4], np.array([1, 1, 1, 1])) == []
    assert nearcopy.nearest_apart(f[:4], np.array([1, 1, 1, 9])) == [(0, 3), (3, 0)]


def in_lists(first, *columns):
    batch = pa.RecordBatch.from_arrays([pa.array(np.asarray(c), pa.int64()) for c in columns], names=[f"c{i}" for i in range(len(columns))])
    return {(a, b) for out in nearcopy._pairs(first)(iter([batch])) for a, b in zip(*out.to_pydict().values())}


def test_a_pair_meets_in_every_table_with_unrelated_members_in_its_list():
    rng = np.random.default_rng(6)
    for table in range(3):
        for n in (3, 40):
            f = np.sort(rng.integers(0, 2**62, n))
            f[-1] = f[0] ^ 5
            f = np.sort(f)
            pair = next((int(x), int(x) ^ 5) for x in f if int(x) ^ 5 in f.tolist())
            assert (min(pair), max(pair)) in in_lists(True, np.full(n, table << 24), f)


def test_every_member_with_a_partner_is_in_a_pair():
    rng = np.random.default_rng(7)
    v = [int(x) for x in rng.integers(0, 2**62, 5)]
    for x in list(v):
        for _ in range(40):
            x ^= 1 << int(rng.integers(0, 64))
            v.append(x)
    v = np.unique(np.array(v, np.uint64))
    near = (np.bitwise_count(v[:, None] ^ v) <= nearcopy.REACH).sum(1) - 1
    found, more = nearcopy.covered_first(v)
    paired = Counter(i for p in found for i in set(p))
    assert len(found) <= 2 * len(v) and all(paired[i] >= min(1, near[i]) for i in range(len(v)))
    assert all(paired[i] >= near[i] or i in more for i in range(len(v)) if near[i] > 1)


def test_pairs_of_groups_are_given_until_all_are():
    rng = np.random.default_rng(9)
    f = np.repeat(rng.integers(0, 2**62, (1, 4)), 30, axis=0)
    f[:, 0] ^= np.arange(30)
    label = np.arange(30) // 3
    want = {(int(f[i, 0]), int(f[j, 0])) for i in range(30) for j in range(30) if f[i, 0] < f[j, 0] and label[i] != label[j]}
    columns = np.zeros(30), f[:, 0], label, *f[:, 1:].T
    batch = pa.RecordBatch.from_arrays([pa.array(np.asarray(c), pa.int64()) for c in columns], names=list("kabcde"))
    for most in (1, 4, 1000):
        got = {(a, b) for out in nearcopy._pairs(False, most)(iter([batch])) for a, b in zip(*out.to_pydict().values())}
        apart = {p for p in got if p[0] != p[1]}
        assert apart <= want and (apart == want or len(apart) < len(got))
    assert got == want


def test_a_partner_behind_one_that_fails_is_found(spark, monkeypatch):
    # Texts 0 and 2 are near copies; the nearest of each by its bits is another text.
    texts = [" ".join(f"w{i}" for i in range(60)), "none of it", " ".join(f"w{i}" for i in range(61)), "nor of this"]
    f = [0, 0b1, 0b1110, 0b1111]

    def prints(shingle):
        def run(batches):
            for batch in batches:
                n = batch.num_rows
                at = pa.array([f[i] for i in batch.column(0).to_pylist()], pa.int64())
                zero = [*[pa.array([bytes([v]) * 32] * n, pa.binary()) for v in (128, 0)], pa.array([99] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], at, *[pa.array([0] * n, pa.int64())] * 3, *zero], names=[x.split()[0] for x in nearcopy._PRINT.split(", ")])

        return run

    monkeypatch.setattr(nearcopy, "_prints", prints)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r["doc_id"]: r["root"] for r in nearcopy.near_copies(df).collect()}
    assert root[0] == root[2] and len(set(root.values())) == 3


def test_sets_link_as_all_pairs_do():
    rng = np.random.default_rng(3)
    sets = [rng.choice(60, 12, replace=False) for _ in range(6)]
    for _ in range(150):
        x = sets[rng.integers(len(sets))].copy()
        x[rng.integers(len(x))] = rng.integers(60, 90)
        sets.append(x[: rng.integers(10, 13)])
    sets = [np.unique(x).astype(np.uint32) for x in sets]
    want = list(range(len(sets)))
    while (new := [min(want[j] for j in range(len(sets)) if likeness(set(x.tolist()), set(sets[j].tolist())) >= 0.8) for x in sets]) != want:
        want = new
    found = nearcopy.link_sets(sets, 0.8)
    got = simhash._Sets()
    for i, j in found:
        got.join(i, j)
    assert len(set(zip(want, map(got.root, range(len(sets)))))) == len(set(want)) == len(sets) - len(found)


def test_lists_of_several_groups_link_as_all_pairs_do():
    rng = np.random.default_rng(3)
    sets = [rng.choice(60, 12, replace=False) for _ in range(6)]
    for _ in range(60):
        x = sets[rng.integers(6)].copy()
        x[rng.integers(12, size=2)] = rng.integers(60, 90, 2)
        sets.append(x)
    sets = [np.unique(x).astype(np.uint32) for x in sets]
    labels = [i if i < 40 else 40 for i in range(len(sets))]

    def groups(links):
        tree = simhash._Sets()
        for i, j in links:
            tree.join(labels[i], labels[j])
        return [tree.root(x) for x in labels]

    found = nearcopy.link_apart(sets, labels, 0.8)
    every = [(i, j) for i in range(len(sets)) for j in range(i) if likeness(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
    assert groups(found) == groups(every) and 0 < len(found) < len(set(labels)) and 1 < len(set(groups(every)))


def test_lists_of_the_same_members_are_compared_once(spark):
    lists = {1: [10, 11], 2: [10, 11], 3: [10, 12], 4: [10, 11, 12], 5: [13], 6: [11, 12], 7: [12, 11]}
    label = {10: 1, 11: 2, 12: 1, 13: 3}
    posts = lambda of: spark.createDataFrame([(t, k, of(k)) for t, own in lists.items() for k in own], "token long, k1 long, label long")
    tokens = lambda df: sorted(r["token"] for r in df.collect())
    assert tokens(nearcopy.distinct_lists(posts(label.get), True)) == [1, 4, 6]
    assert tokens(nearcopy.distinct_lists(posts(lambda k: None), False)) == [1, 3, 4, 6]


def test_verified_pairs_of_a_task_are_a_forest():
    sets = [np.arange(i, 100 + i, dtype=np.uint32).tobytes() for i in range(6)] + [np.arange(500, 600, dtype=np.uint32).tobytes()]
    pairs = [(i, j) for i in range(7) for j in range(i)]
    batch = pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)] + [pa.array([sets[p[k]] for p in pairs], pa.binary()) for k in (0, 1)], names=["ka", "kb", "sa", "sb"])
    found = [x for out in nearcopy._verified(0.8)(iter([batch.slice(0, 9), batch.slice(9)])) for x in zip(*out.to_pydict().values())]
    assert len(found) == 5 and {x for p in found for x in p} == set(range(6))


def test_shuffle_files_of_a_stored_table_are_released(spark):
    from lexigrid.session import stored

    held = lambda: set(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before = held()
    out = stored(spark.range(1000).repartition(3, "id").groupBy("id").count(), "released")
    assert not [f for f in held() - before if "/shuffle_" in f]
    assert out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_what_simhash_links_are_near_copies(spark):
    base = [f"w{i}" for i in range(20)] * 60
    more = base + [f"x{i}" for i in range(14)]
    assert likeness(shingles(" ".join(base)), shingles(" ".join(more))) < 0.8
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(more)), (3, "other words")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    root = {r["doc_id"]: r["root"] for r in nearcopy.near_copies(df).collect()}
    assert root[1] == root[2] != root[3]


def test_short_near_copies_are_found_however_far_their_bits(spark):
    rnd, rows = random.Random(12), []
    while len(rows) < 40:
        w = ["".join(rnd.choice("abcdefghijklmno") for _ in range(6)) for _ in range(9)]
        a, b = (nearcopy.wide_simhash(" ".join(x))[0] for x in (w, w[:8]))
        if np.bitwise_count(a ^ b).sum() > 54:
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:8]))]
    root = {r["doc_id"]: r["root"] for r in nearcopy.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(root[i] == root[i + 1] for i in range(0, 40, 2)) and len(set(root.values())) == 20


def test_a_large_group_of_near_copies_stays_one(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(2, 8)))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(word() for _ in range(100))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    roots = {r["doc_id"]: r["root"] for r in nearcopy.near_copies(df).collect()}
    sets = [shingles(t) for _, t in rows[:300]]
    label = list(range(300))
    while True:
        new = [min(label[j] for j in range(300) if likeness(sets[i], sets[j]) >= 0.8) for i in range(300)]
        if new == label:
            break
        label = new
    assert len({roots[i] for i in range(300)}) <= len(set(label)) + 2 and len({roots[1000 + i] for i in range(50)}) == 50


def test_keep_one_keeps_one_of_each_group(awkward, with_null_id, empty):
    least = {}
    for r in nearcopy.near_copies(awkward).collect():
        least[r["root"]] = min(least.get(r["root"], 1 << 62), r["doc_id"])
    kept = nearcopy.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert nearcopy.keep_one(with_null_id).where("text = 'lost and found'").count() == 1
    assert nearcopy.keep_one(empty).count() == 0


def test_link_list_finds_what_all_pairs_find():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    v = [int(b) for b in base]
    for b in base:
        x = int(b)
        for _ in range(60):
            x ^= 1 << int(rng.integers(0, 64))
            v.append(x)
    v = np.unique(np.array(v, np.uint64))
    sets = simhash._Sets()
    simhash.link_list(v, 4, sets)
    ids = v.view(np.int64).tolist()
    want = brute_components([int(x) for x in v])
    got = [sets.root(i) for i in ids]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def brute_removed(rows, span):
    seen, out = {}, {}
    texts = [(r[0], re.findall(WORD, r[1] or "")) for r in rows]
    least = {}
    for d, w in texts:
        for i in range(len(w) - span + 1):
            k = tuple(w[i : i + span])
            least[k] = min(least.get(k, 1 << 62), d)
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            if least[tuple(w[i : i + span])] < d:
                gone[i : i + span] = [True] * span
        out[d, tuple(w)] = [x for x, g in zip(w, gone) if not g]
    del seen
    return out


def test_substring_query_against_brute_force(spark, put, awkward, docs_rows):
    want = brute_removed(docs_rows, 50)
    got = substring.op8_substring_dedup(spark, put(documents=awkward)).collect()
    assert len(got) == len(docs_rows)
    expected = Counter((d, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, w, k in ((r[0], tuple(re.findall(WORD, r[1] or "")), want[r[0], tuple(re.findall(WORD, r[1] or ""))]) for r in docs_rows))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == expected
    assert sum(r["n_removed"] for r in got) > 0


def test_substring_with_other_spans_and_tables(awkward, docs_rows, empty, with_null_id):
    want = brute_removed(docs_rows, 8)
    out = substring.without_repeats(awkward, 8, 3)
    assert out.columns == awkward.columns
    for r in out.collect():
        own = [x for x in docs_rows if x[0] == r["doc_id"]][0]
        w = tuple(re.findall(WORD, own[1] or ""))
        kept = want[r["doc_id"], w]
        assert r["text"] == (own[1] if len(kept) == len(w) else " ".join(kept))
    assert substring.without_repeats(empty).count() == 0
    assert substring.without_repeats(with_null_id).count() == with_null_id.count()


def test_words_that_a_polynomial_takes_for_equal_are_told_apart(spark):
    mirror = ["a", "b"]
    while len(mirror[0]) < 2048:
        mirror = [mirror[0] + mirror[1], mirror[1] + mirror[0]]
    words = [f"w{i}" for i in range(61)]
    rows = [(i, " ".join(words[:30] + [m] + words[31:])) for i, m in enumerate(mirror)]
    out = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == rows


def test_rows_without_an_id_and_repeated_ids_keep_their_own_words(spark):
    some = spark.range(20000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat_ws(' ', transform(sequence(1, 60), i -> concat(id, 'x', i))) AS text")
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(55)]
    rows = [(1, " ".join(passage)), (7, " ".join(["a", *passage])), (7, " ".join([*passage, "b"])), (7, "c"), (None, " ".join(passage))]
    rows += [(20 + i, " ".join(rnd.choice("xyz") for _ in range(rnd.randint(40, 120)))) for i in range(20)]
    out = substring.without_repeats(some.union(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    got = Counter(map(tuple, out))
    assert len(out) == 20000 + len(rows) and got[(7, "a")] == got[(7, "b")] == got[(7, "c")] == got[(None, "")] == 1
    assert sum(n for (d, t), n in got.items() if d is None and len(t.split()) == 60) == 20000


def test_a_text_of_several_megabytes(spark):
    rnd = random.Random(5)
    long = [str(rnd.randrange(10**9)) for _ in range(500_000)]
    rows = [(2, " ".join(long[1000:400_000])), (1, " ".join(long)), (3, " ".join([*long[-60:], "tail"])), (4, "x" * 3_000_000)]
    out = {r["doc_id"]: r["text"] for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[1][1], 2: "", 3: "tail", 4: rows[3][1]}


def test_substring_sql_agrees(spark, put, awkward, docs_rows):
    import duckdb

    folder = put(documents=awkward.where("doc_id <> 15").dropDuplicates(["doc_id"]))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = Counter(duckdb.sql(substring.OP8_SQL).fetchall())
    assert Counter(map(tuple, substring.op8_substring_dedup(spark, folder).collect())) == want and want


def test_links_of_long_lists_that_are_dealt_out_again(spark):
    rng = np.random.default_rng(4)
    v = {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)}
    for b in list(v)[:8]:
        x = b
        for _ in range(60):
            x ^= 1 << int(rng.integers(0, 63))
            v.add(x)
    # All of these share bytes with many others.
    v |= {(7 << 40) + int(x) for x in rng.integers(0, 2**30, 200)}
    v = sorted(v)
    want = brute_components([x % (1 << 64) for x in v])
    distinct = spark.createDataFrame([(x,) for x in v], "fp long")
    for most in (3, 20, 4096):
        sets = simhash._Sets()
        for r in simhash.links(distinct, 4, most).collect():
            assert bin((r["a"] ^ r["b"]) % (1 << 64)).count("1") <= 60
            sets.join(r["a"], r["b"])
        got = [sets.root(x) for x in v]
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_count_filter_rejects_what_shares_too_few_bytes():
    x = np.array([0x0101010100000000, 0x0101010101000000, 0x0F], np.uint64)
    assert simhash.shared_bytes(x).tolist() == [4, 3, 7] and simhash.linked(x, 4).tolist() == [True, False, True]


def test_paths_that_do_not_branch_are_compacted(spark):
    # 1-2-3-4-5 follow one another in both of two places; 7 is followed by 8 once and by nothing once; 9 has two widths.
    rows = [(i, i, 2, 3, 3, (i + 1, i + 1) if i < 5 else None, (i + 1, i + 1) if i < 5 else None, 2 if i < 5 else 0) for i in range(1, 6)]
    rows += [(7, 7, 2, 4, 4, (8, 8), (8, 8), 1), (8, 8, 1, 2, 2, None, None, 0), (9, 9, 2, 1, 5, (5, 5), (5, 5), 2)]
    edges = spark.createDataFrame(rows, "path1 long, path2 long, n long, w0 int, w1 int, s0 struct<next1:long,next2:long>, s1 struct<next1:long,next2:long>, successors long")
    assert {(r["path1"], r["windows"]) for r in substring.compacted(edges).collect()} == {(1, 15), (7, None), (8, None), (9, None)}
