import random

import numpy as np
import xxhash

from pyspark.sql import functions as F
from rivulet.llm import simhash
from rivulet.llm.common import Workspace, connected_components

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    k = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=3):
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_fingerprint_matches_spark_hash_and_brute_force(spark):
    texts = ["one two three four", "One\tTWO  three\nfour five", "", " ", "word", "é È ü z", "a b c a b c a b c"]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert simhash.fingerprint(text) == whole


def clustered(n, rng):
    """Fingerprints in balls and chains around a few centres."""
    out = []
    for _ in range(n):
        c = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            for b in rng.sample(range(64), rng.randint(0, 4)):
                c ^= 1 << b
            out.append(c)
    return sorted(set(out))


def found_components(spark, fps, **more):
    ws = Workspace(spark, "t")
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(ws, ws.keep(simhash.links(ws, df, 3, **more), "e")).collect()}
    group = {}
    return [group.setdefault(roots.get(s, s), i) for i, s in enumerate(signed)]


def test_pairs_and_dense_blocks_agree_with_brute_force(spark):
    fps = clustered(60, random.Random(5))
    want = slow_components(fps)
    assert found_components(spark, fps) == want
    assert found_components(spark, fps, dense_from=1) == want


def test_no_random_radius_is_missed(spark):
    rng = random.Random(9)
    a = [rng.getrandbits(64) for _ in range(200)]
    b = [x ^ sum(1 << k for k in rng.sample(range(64), 3)) for x in a]
    got = found_components(spark, a + b)
    assert got[200:] == list(range(200))


def test_components_of_odd_rows(spark, odd_docs, no_docs):
    got = [tuple(r) for r in simhash.components(spark, odd_docs).collect()]
    assert len(got) == odd_docs.count()
    by = {}
    for i, fp, c in got:
        by.setdefault(i, []).append((fp, c))
    assert by[0] == by[1][:1] == [(by[0][0][0], 0)] and len(by[1]) == 2
    # null, empty and blank texts have fingerprint zero and are one component
    assert {x for i in (2, 3, 5) for x in by[i]} == {("0" * 16, 2)}
    assert by[None][0][1] is None
    assert simhash.components(spark, no_docs).count() == 0


def test_query_on_small_table(spark):
    from rivulet.llm.queries import op9_simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [slow_fingerprint(r[1] or "") for r in docs]
    want = {r[0]: (f"{f:016x}", docs[c][0]) for r, f, c in zip(docs, fps, slow_components(fps), strict=True)}
    assert {r[0]: (r[1], r[2]) for r in op9_simhash(spark, SF).collect()} == want


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(900, 901)]
    random.Random(1).shuffle(chain)
    ws = Workspace(spark, "t")
    got = dict(map(tuple, connected_components(ws, spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(300)) and got[901] == 900
    assert np.unique(list(got.values())).tolist() == [0, 100, 900]


def shingles(text, k=5):
    w = text.lower().split()
    k = min(k, len(w))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    common = [word() for _ in range(40)]
    texts, origin = [], []
    for d in range(120):
        base = [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        origin.append(d)
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 60)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            origin.append(d)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(map(tuple, simhash.near_classes(spark, df).collect()))
    missed = total = 0
    for i, t in enumerate(texts):
        first = origin.index(origin[i])
        a, b = shingles(t), shingles(texts[first])
        if i != first and len(a & b) >= 0.8 * len(a | b):
            total += 1
            missed += got[i] != got[first]
        assert origin[got[i]] == origin[i]
    assert total > 200 and missed <= 0.05 * total


def test_near_classes_of_odd_rows(spark, odd_docs, no_docs):
    got = sorted(map(tuple, simhash.near_classes(spark, odd_docs).collect()))
    assert got == [(0, 0), (1, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 2), (6, 6), (7, 7), (8, 8)]
    assert simhash.near_classes(spark, no_docs).count() == 0


def test_tree_links_join_what_is_connected():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (6, 4), dtype=np.uint64)
    prints = np.concatenate([base[i % 6] ^ (np.uint64(1) << rng.integers(0, 64, 4).astype(np.uint64)) for i in range(80)]).reshape(-1, 4)
    links = simhash._tree_links(np.arange(80), prints, 12)
    assert len(links) == 80 - 6


def test_dense_blocks_in_parts_give_the_same_classes(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    texts = []
    for family in range(6):
        base = [word() for _ in range(150)]
        for _ in range(60 if family == 0 else 12):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, simhash.near_classes(spark, df).collect()))
    parts = sorted(map(tuple, simhash.near_classes(spark, df, dense_from=5).collect()))
    assert whole == parts and len({c for _, c in whole}) < len(texts) / 3


def test_parts_of_one_block_lose_no_class(spark):
    """A block without one large group: every connected pair has to meet in some part."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (9, 4), dtype=np.uint64)
    prints = np.concatenate([base[i % 9] ^ (np.uint64(1) << rng.integers(0, 64, 4).astype(np.uint64)) for i in range(180)]).reshape(-1, 4)
    rows = [(7, 180, i, *map(int, p.view(np.int64))) for i, p in enumerate(prints)]
    shown = ["f4", "f5", "f6", "f7"]
    dense = spark.createDataFrame(rows, "block long, n long, rep long, f4 long, f5 long, f6 long, f7 long")
    ws = Workspace(spark, "parts")
    edges = simhash._spread_links(ws, dense, shown, 12, 16)
    roots = dict(map(tuple, connected_components(ws, edges).collect()))
    assert [roots[i] for i in range(180)] == [i % 9 for i in range(180)]
