"""Each stage against a plain account of what it has to do, on its predecessor's output."""

import corpus_pipeline as p
from tests.conftest import SF001
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import texts_after
from tests.llm.test_pipeline_stages import firsts


def test_stages_on_whole_table(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, before = docs.columns, None
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    for name, stage in p.STAGES:
        path = f"{tmpdir_path}/{name}"
        before = docs.collect()
        stage(spark, docs, SF001).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        texts = [(r.doc_id, r.text) for r in before]
        if name != "mix":
            assert docs.columns == columns
        if name == "quality":
            labels = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
            clean = [i for i, _ in texts if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
            junk = [i for i, _ in texts if i in labels and labels[i].quality == 0]
            assert sum(i in after for i in clean) >= 0.97 * len(clean) and sum(i in after for i in junk) <= 0.1 * len(junk)
        elif name == "lines":
            assert {i: r.text for i, r in after.items()} == texts_after(texts)
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_duplicates":
            assert set(after) == firsts(texts)
        elif name == "decontaminate":
            assert set(after) == {i for i, _ in texts} - {i for i, _ in leaks(texts, items)}
        else:
            size = {i: len(t.split()) for i, t in texts}
            assert all(1 <= r.copies <= 3 for r in after.values())
            assert abs(sum(size[i] * r.copies for i, r in after.items()) - sum(size.values())) <= 64 * 20


def test_odd_rows_go_through(spark, tmpdir_path):
    base = spark.read.parquet(f"{SF001}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (7, None, None, "s", None),
                                 (8, " \n ", "en", None, 3)], base.schema)
    docs = base.unionByName(odd)
    docs = docs.selectExpr("*", "1 as component", "'x' as n_removed", "2 as h", "'z' as keep")
    for name, stage in p.STAGES:
        path = f"{tmpdir_path}/{name}"
        docs.write.parquet(path + "-in")
        docs = spark.read.parquet(path + "-in")
        columns = docs.columns
        docs = stage(spark, docs, SF001)
        assert name == "mix" or docs.columns == columns
    assert docs.count() > 0


def test_empty_documents(spark, tmpdir_path):
    spark.read.parquet(f"{SF001}/documents.parquet").filter("false").write.parquet(f"{tmpdir_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF001}/{name}.parquet").write.parquet(f"{tmpdir_path}/{name}.parquet")
    assert p.run(spark, tmpdir_path).count() == 0
