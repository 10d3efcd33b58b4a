import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[1] == counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[4] == counts[3] == counts[5]
    assert "token =" not in "".join(r["text"] for r in corpus_pipeline.without_secrets(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("text").collect())
    assert corpus_pipeline.run(spark, sf).count() == counts[-1]


def test_rejected_and_odd_rows(spark, docs):
    kept = corpus_pipeline.identified(spark, docs, "").collect()
    assert not {5000, 5001, 5002, 5004} & {r["doc_id"] for r in kept}


SF = "/root/testdata/sf0.001"


def test_odd_rows_and_clashing_columns_through_all_stages(spark, docs, rows):
    kept = {str(i) for i, _, _ in rows}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        frame = out.cache()
        ids = {str(r["doc_id"]) for r in frame.select("doc_id").collect()}
        assert ids <= kept, name
        # The row without an id is a copy of one with an id, which stays.
        assert ("None" in ids) == (name == "language_id"), name
        kept = ids


def test_empty_tables_through_all_stages(spark, empty):
    frame = empty
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
        assert frame.count() == 0


def test_one_row_of_repeats_survives_whatever_else_differs(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, k) for k in (5, 3, 4)] + [(None, None, 1), (None, None, 2), (2, "", 1), (3, "  ", 1), (4, "one word", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node int")
    made = [sorted(map(str, corpus_pipeline.deduplicated(spark, frame.repartition(n), SF).collect())) for n in (1, 4)]
    assert made[0] == made[1]
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.deduplicated(spark, frame, SF).collect()) == ["1", "2", "4"]


def test_a_very_long_text_through_the_stages(spark):
    words = " ".join(f"word{k % 900} und{k % 77}" for k in range(60_000))
    frame = spark.createDataFrame([(1, words + " password=hunter22 end", "en", 1), (2, "the short text of another document", "en", 1)] * 1, "doc_id long, text string, lang string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:
        frame = stage(spark, frame, SF)
    assert {r["doc_id"] for r in frame.collect()} == {1, 2}
