"""Exact round trips of the tokenising operators."""

import numpy as np
import pytest

from rivulet.llm import packing, token_index
from rivulet.llm.tokens import WordIds, vocabulary, wide


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: r[1] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_library_s(library, texts, monkeypatch):
    tool = WordIds(vocabulary())
    odd = [
        "", None, "It's they'll I'd we've 'tis rock'n'roll", "a\x85b c\xa0d e", "ÀÉ×Þß µ² ½ ª º", "x\x1cy\x1dz\x00", "İ Σ ΑΣ ǆ", "日本 語", "<|endoftext|> a <|start",
        "1234567890", "...?!,, --- ''''s 's's", "word,word;word", "ABC" * 500,
    ]
    given = odd + list(texts.values())
    want = [plain(library, t) for t in given]
    for limit in (10, 800_000):  # a worker whose memory is full gives the same
        monkeypatch.setattr("rivulet.llm.tokens.MEMORY", limit)
        for _ in range(2):
            got = tool.many(given)
            assert [np.frombuffer(wide(g, tool.kind), "<u4").tolist() for g in got] == want
        tool.known.clear()


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 1000, 5000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        h = token_index.PerfectHash.build(keys)
        assert sorted(h.slots(keys)) == list(range(len(keys)))
    assert sorted(token_index.PerfectHash.build(np.arange(777)).slots(np.arange(777))) == list(range(777))


def test_index_refuses_other_keys():
    keys = np.arange(0, 4000, 2)
    raw = token_index.pack_index(keys, np.zeros(len(keys), bool), np.ones(len(keys), np.int64))
    index = token_index.ShardIndex(raw)
    assert all(index.find(int(k)) == (i, 1) for i, k in enumerate(keys[:200]))
    assert all(index.find(int(k)) is None for k in range(1, 2000, 2))


def test_shards_round_trip(spark, library, texts, brute, tmp_path):
    from rivulet.llm.queries import op2_token_index

    start, want = 0, {}
    for i in sorted(texts):
        ids = [*plain(library, texts[i]), 2]
        want[i] = (start, len(ids), brute.crc(ids))
        start += len(ids)
    assert {r[0]: tuple(r)[1:] for r in op2_token_index(spark, SF2).collect()} == want
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    folder = f"file://{tmp_path}/ix"
    token_index.write(docs, folder, vocabulary(), 2, 5)
    index = token_index.TokenIndex(spark, folder)
    for i in list(texts)[:40]:
        assert index.get(i).tolist() == [*plain(library, texts[i]), 2]
    assert index.get(10**9) is None and index.get(-5) is None


SF2 = "/root/testdata/sf0.001"


def test_odd_rows_round_trip(spark, library, odd_docs, no_docs, brute):
    got = token_index.round_trip(odd_docs, vocabulary()).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted(
        (str(r[0]), len(ids), brute.crc(ids)) for r in rows for ids in [[*plain(library, r[1]), 2]]
    )
    ordered = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in ordered] == list(np.cumsum([0] + [r[2] for r in ordered])[:-1])
    assert ordered[0][0] is None and [r[0] for r in ordered[1:]] == sorted(r[0] for r in ordered[1:])
    assert token_index.round_trip(no_docs, vocabulary()).count() == 0


def check_packed(rows, size):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= size
    return seqs


def test_packing(spark, library, texts, brute):
    from rivulet.llm.queries import op4_packing

    rows = op4_packing(spark, SF2).collect()
    seqs, by = check_packed(rows, 4096), {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in texts.items():
        ids = [*plain(library, t), 1]
        assert sorted(by[i]) == [(k // 4096, k, len(ids[k : k + 4096]), brute.crc(ids[k : k + 4096])) for k in range(0, len(ids), 4096)]
    total = sum(r["length"] for r in rows)
    assert len(seqs) <= -(-total // 4096) + 1


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs, vocabulary()).collect()
    check_packed(rows, 4096)
    assert len({(r["doc_id"]) for r in rows}) == 10 and sum(r["piece"] == 0 for r in rows) == 11
    assert packing.pack(no_docs, vocabulary()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.geometric(0.01, 800), 500)
    p = packing.PackParams(tokens=1000, documents=6, attention=500.0**2, rule=rule)
    bins, offsets = packing.best_fit(lengths, p)
    for b in np.unique(bins):
        mine = lengths[bins == b]
        assert mine.sum() <= 1000 and len(mine) <= 6 and (mine.astype(float) ** 2).sum() <= 500.0**2
        order = np.argsort(offsets[bins == b])
        assert (offsets[bins == b][order] == np.cumsum(np.r_[0, mine[order][:-1]])).all()
    lower = max(lengths.sum() / 1000, len(lengths) / 6, (lengths.astype(float) ** 2).sum() / 500.0**2)
    assert len(np.unique(bins)) <= 1.25 * lower + 1


def test_pieces_follow_the_attention_capacity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id bigint, text string")
    rows = packing.pack(docs, vocabulary(), p=packing.PackParams(tokens=8, attention=25.0)).collect()
    assert max(r["length"] for r in rows) == 5 and sum(r["length"] for r in rows) == 13


def test_a_hot_key_is_spread_over_shards(spark, library, tmp_path):
    rows = [(7, f"copy number {i % 50}") for i in range(300)] + [(i, f"text {i}") for i in range(-40, 60) if i != 7] + [(None, "no key")] * 90
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    folder = f"file://{tmp_path}/hot"
    manifest = token_index.write(docs, folder, vocabulary(), 2, 6).orderBy("shard").collect()
    assert max(r["rows"] for r in manifest) < 200 and sum(r["low"] == 7 or r["high"] == 7 for r in manifest) > 2
    got = sorted(token_index.read(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    index, first = token_index.TokenIndex(spark, folder), next(r for r in got if r["doc_id"] == 7)
    assert len(index.get(7)) == first["n_tokens"]
    for i in (-40, 0, 6, 8, 59):
        assert index.get(i).tolist() == [*plain(library, f"text {i}"), 2]
    assert index.get(60) is None and index.get(-41) is None


def test_long_texts_are_split_at_spaces(library, monkeypatch):
    monkeypatch.setattr("rivulet.llm.tokens._SLICE", 16)
    text = "\tÉtude no. 1,  a-b don't " + "x" * 40 + " end\n" + "word " * 30
    tool = WordIds(vocabulary())
    assert np.frombuffer(tool.one(text), tool.kind).tolist() == plain(library, text)
