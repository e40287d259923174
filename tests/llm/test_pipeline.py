import corpus_pipeline as cp
from rivulet.llm import decontam

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, seen[-1], SF)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    ids = [{r[0] for r in s.select("doc_id").collect()} for s in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[-1]
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    # one of each group of exact copies stays
    kept = {r[0]: r[1] for r in seen[2].select("doc_id", "text").collect()}
    before = {r[0]: r[1] for r in seen[1].select("doc_id", "text").collect()}
    assert set(kept.values()) <= set(before.values())
    assert len(set(kept.values())) == len(kept)
    # no item is left in what decontamination kept, and it took nothing else
    items = [decontam.normal(r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in decontam.normal(texts[d]) for d in ids[3] for i in items)
    assert all(any(i in decontam.normal(texts[d]) for i in items) for d in ids[2] - ids[3])
    # redaction keeps every document
    assert ids[4] == ids[3]
    redacted = [r for r in seen[4].collect() if "[REDACTED]" in r["text"]]
    assert redacted and all(r["n_chars"] == len(r["text"]) for r in redacted)
    assert ids[5] == ids[4]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_odd_rows(spark, odd_docs):
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd_docs, SF)
        assert out.columns == odd_docs.columns, name
        rows = out.collect()
        assert len(rows) >= 6 and {(r["h"], r["row"], r["fp"]) for r in rows} == {("x", 1, "y")}
