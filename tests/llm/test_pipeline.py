import corpus_pipeline
from tesserae.llm import decontaminate, toxicity
from tesserae.llm.common import table

from .test_ngram_join import brute as components


def test_every_stage_does_its_work(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs, names = table(spark, d, "documents"), table(spark, d, "documents").columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == names
        kept.append(docs)
    toxic, lines, joined, clean, packed = kept
    labels = table(spark, d, "labels")
    flagged = {r.doc_id for r in toxicity.score(table(spark, d, "documents"), labels).where("predicted = 1").collect()}
    assert flagged and {r.doc_id for r in toxic.collect()} == {r.doc_id for r in table(spark, d, "documents").collect()} - flagged
    assert lines.count() == toxic.count()
    before = [(r.doc_id, r.text) for r in lines.collect()]
    assert {r.doc_id for r in joined.collect()} == {i for i, _, c in components(before) if i == c}
    assert decontaminate.report(joined, table(spark, d, "benchmark")).where("contaminated").count() > 0
    assert decontaminate.report(clean, table(spark, d, "benchmark")).where("contaminated").count() == 0
    untouched = {r.doc_id: r.text for r in clean.collect()}
    for r in decontaminate.report(joined, table(spark, d, "benchmark")).where("not contaminated").join(joined, "doc_id").collect():
        assert untouched[r.doc_id] == r.text
    assert {r.doc_id for r in packed.collect()} == set(untouched)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_awkward_documents_pass_every_stage(spark, tmp_path):
    """Null ids and texts, repeated rows, extra columns and an empty table; labels and benchmark with nulls of their own."""
    from .helpers import awkward, documents

    d = str(tmp_path / "sf")
    spark.createDataFrame([(3, 1, 0), (4, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b"), (2, "!!")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for k, docs in enumerate((awkward(spark), documents(spark, []))):
        names, kept = docs.columns, []
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, d)
            docs.write.parquet(str(tmp_path / f"{k}-{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{i}"))
            assert i == 4 or docs.columns == names
            kept.append(docs.count())
        # rows of equal texts are copies: of 3, 4 and 4 one row stays; a null id is no copy of anything
        assert kept[:4] == ([10, 10, 8, 8] if k == 0 else [0, 0, 0, 0]) and (kept[4] >= 8) == (k == 0)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns[-2:] == ["sequence_id", "offset"] and rows.count() > 0
