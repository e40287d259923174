import random

from rivulet.llm import decontam

SF = "/root/testdata/sf0.01"


def slow(pattern, text):
    """(distance, end) of the first best stretch, by the plain table."""
    row = list(range(len(pattern) + 1))
    best, end = row[-1], 0
    for j, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        if row[-1] < best:
            best, end = row[-1], j
    return best, end


def test_myers_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert decontam.Myers(p).best(t) == slow(p, t)


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [rng.choice("abcxyz")], [out[at], rng.choice("abcxyz")]])
    return "".join(out)


def test_no_match_within_the_budget_is_missed():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, decontam.normal(prose(rng.randint(3, 60)))) for i in range(40)]
    matcher = decontam.Matcher(items, 0.08)
    for _ in range(150):
        i, item = rng.choice(items)
        k = rng.randint(0, decontam.budget(item, 0.08) + 3)
        doc = decontam.normal(prose(30) + " " + edited(rng, item, k) + " " + prose(30))
        want = {j: slow(x, doc)[0] for j, x in items}
        got = {j: (d, end) for j, d, _, end in matcher.find(doc)}
        assert {j: d for j, (d, _) in got.items()} == {j: d for j, d in want.items() if d <= decontam.budget(items[j][1], 0.08)}
        for j, (d, end) in got.items():
            assert slow(items[j][1], doc[:end])[0] == d


def test_pieces_make_up_the_item():
    for k in range(6):
        assert "".join(p for _, p in decontam.pieces("abcdefghij", k)) == "abcdefghij" and len(decontam.pieces("abcdefghij", k)) == k + 1


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontam.matches(docs, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 2000)
    assert sorted(map(tuple, decontam.matches(docs, items).collect())) == whole
    exact = {(d[0], i[0]) for d in docs.collect() for i in items.collect() if decontam.normal(i[1]) in decontam.normal(d[1])}
    assert exact and exact <= {(r[0], r[1]) for r in whole}


def test_odd_rows(spark, odd_docs):
    items = spark.createDataFrame(
        [(1, "the same text again and again"), (1, "the same text again and again"), (2, None), (3, ""), (None, "no id HERE, at"), (4, "w w w w w w w w w w")], "item_id bigint, text string"
    ).selectExpr("*", "'z' AS doc_id")
    got = sorted(map(str, ((r[0], r[1]) for r in decontam.matches(odd_docs, items).collect())))
    assert got == sorted(map(str, [(0, 1)] * 2 + [(1, 1)] * 4 + [(None, None), (4, 4)]))
    assert decontam.matches(odd_docs, items.limit(0)).count() == 0 and decontam.matches(odd_docs.limit(0), items).count() == 0
