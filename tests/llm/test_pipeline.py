import corpus_pipeline as P
from samewise.llm import decontaminate, langid, pii, queries, simhash


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    kept = {}
    for i, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, data)
        docs = P.staged(docs, name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert set(kept[name]) <= set(before)
        if i < len(P.STAGES) - 1:
            assert docs.columns == columns
    first = spark.read.parquet(f"{data}/documents.parquet")
    ok = {r.doc_id for r in langid.languages(first).collect() if r.accepted}
    assert set(kept["language_id"]) == ok
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(first.where(first.doc_id.isin(list(ok)))).collect()}
    assert set(kept["simhash_near_dedup"]) == set(near.values())
    pool = spark.createDataFrame([(r.doc_id, r.text) for r in kept["simhash_near_dedup"].values()], "doc_id long, text string")
    leaks = {r.doc_id for r in decontaminate.contaminated_pairs(pool, bench).collect()}
    assert leaks and set(kept["decontamination"]) == set(kept["simhash_near_dedup"]) - leaks
    for i, r in kept["personal_data"].items():
        assert r.text == pii.redact(kept["decontamination"][i].text) and r.n_chars == len(r.text)
    assert set(kept["sentencepiece"]) == set(kept["personal_data"]) and all(r.round_trip for r in kept["sentencepiece"].values())


def test_run_and_names(spark, data):
    assert P.run(spark, data).count() > 100
    assert len({n.split("_")[0] for n in queries.QUERIES}) == 10
