import hashlib

import corpus_pipeline as P
from notespan.llm import secrets
from tests.llm import fixtures as X
from tests.llm.test_corpora import linked

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = X.frame(spark)
    near = P.one_of_each(spark, docs, SF)
    assert near.columns == docs.columns
    want = {i for i, (_, c) in linked(X.known()).items() if c == i}
    assert {r["doc_id"] for r in near.collect() if r["doc_id"] is not None} == want
    for stage in (P.keep_quality, P.no_benchmarks, P.no_secrets):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert stage(spark, X.empty(spark), SF).count() == 0
    assert P.no_benchmarks(spark, docs, SF).count() == docs.count()


def test_last_stages_on_empty_tables(spark):
    assert P.one_of_each(spark, X.empty(spark), SF).count() == 0
    out = P.token_ids(spark, X.empty(spark), SF)
    assert out.count() == 0 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)


def test_run_of_odd_rows(spark, tmp_path):
    docs = X.frame(spark, 40)
    docs.union(docs.where("doc_id in (1, 2)")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path)).select("doc_id").collect()
    ids = [r["doc_id"] for r in got]
    known = [(i, t) for i, t, *_ in X.rows(40) if i is not None]
    want = {i for i, (_, c) in linked(known).items() if c == i}
    assert set(ids) == want and all(ids.count(i) == (2 if i in (1, 2) else 1) for i in want)


def test_run(spark):
    assert [name for name, _ in P.STAGES] == ["quality", "near copies", "benchmarks", "secrets", "token ids"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect()}
    got = {r["doc_id"]: r["decoded_sha256"] for r in P.run(spark, SF).collect()}
    assert got == want and len(got) > 50
    assert secrets.digests(docs).where("n_assign + n_access + n_hex > 0").count() == 0
