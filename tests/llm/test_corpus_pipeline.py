"""The pipeline: stages take effect, in order, on what the stage before kept."""

import duckdb
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from vitalspan.llm import queries
from vitalspan.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts, texts = [docs.count()], {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), "test")
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
            now = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert set(now) <= set(texts)
            if name == "quality rules":
                rejected = {r["doc_id"] for r in queries.QUERIES["op10_quality_rules"](spark, DATA).where("NOT kept").collect()}
                assert set(now) == set(texts) - rejected and all(now[k] == texts[k] for k in now)
            if name == "line dedup":
                assert any(now[k] != texts[k] for k in now)
            if name == "MinHash near-dedup":
                assert len(now) == docs.count() and len(now) < len(texts)
            texts = now
    assert docs.columns[:2] == ["doc_id", "piece"]
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(texts)
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def test_stages_take_empty_and_null_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", None, None), (2, "", None, "a", 0), (3, "words " * 40, "en", "a", 240), (3, "words " * 40, "en", "a", 240)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            materialize(stage(spark, docs, DATA), "test").count()


def test_url_verdicts_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE_SQL['op7_url_filter']})").fetchall())
    got = sorted(map(tuple, queries.QUERIES["op7_url_filter"](spark, DATA).collect()))
    assert got == want


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_stages_keep_columns_of_any_name(spark):
    names = ("kept_id", "line_counts", "mixed_id", "mixed_size", "mixed_copies", "mixed_copy")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        assert out.select(*names).distinct().collect() == [names]


def test_mix_gives_rows_of_one_key_their_own_copies(spark):
    docs = spark.createDataFrame([(1, "a b c d " * 20, "en", "s", 0), (1, "a", "en", "t", 0), (2, "x " * 400, "en", "t", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in corpus_pipeline.mixing.mix_sources(docs).collect()}
    got = {}
    for r in corpus_pipeline.mix(spark, docs, DATA).collect():
        k = r["doc_id"], len(r["text"].split())
        got[k] = got.get(k, 0) + 1
    assert got == {k: c for k, c in copies.items() if c}
