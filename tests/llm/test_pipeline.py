import brute

import corpus_pipeline as pipeline
from recallgrid.llm import pii


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == columns and out.schema == docs.schema
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs.collect())
    language, once, clean, mixed, coded = kept
    assert len(language) >= 0.98 * len(rows)
    prints = [(r.doc_id, brute.fingerprint(r.text)) for r in language]
    firsts = {g for g in brute.groups(prints)}
    assert sorted(r.doc_id for r in once) == sorted(firsts)
    assert {r.doc_id for r in clean} == firsts and all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in clean)
    texts = {r.doc_id: r.text for r in clean}
    words = {i: brute.quality_base(t)[0] for i, t in texts.items()}
    uses = [r.doc_id for r in mixed]
    assert set(uses) <= firsts and max(map(uses.count, uses)) == 2 and all(r.text == texts[r.doc_id] for r in mixed)
    assert abs(sum(words[i] for i in uses) - 1.5 * sum(words.values())) < 0.05 * sum(words.values())
    assert sorted(r.doc_id for r in coded) == sorted(uses) and all(r.round_trip for r in coded)


def test_run_gives_the_same(spark, sf):
    a, b = (sorted((r.doc_id, tuple(r.ids)) for r in pipeline.run(spark, sf).collect()) for _ in range(2))
    assert a == b and a


def test_odd_rows(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "a", 0), (None, "the and of " * 5, "en", "a", 9), (None, None, None, None, None), (3, "the same text here " * 9, "en", "b", 9)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in once.collect() if r.doc_id is not None) == [1, 3]
    assert pipeline.redact_personal_data(spark, docs, "").count() == 10
    for stage in (pipeline.drop_near_duplicates, pipeline.redact_personal_data, pipeline.mix_sources, pipeline.encode_pieces):
        assert stage(spark, docs.limit(0), "").count() == 0
        stage(spark, docs, "").collect()
