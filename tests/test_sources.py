import pytest
from pyspark.sql import functions as F

from vitalspan.functions.dates import resolve_end
from vitalspan.functions.predicates import filter_concepts
from vitalspan.session import literal_frame, materialize, scratch_root
from vitalspan.sources import io, store
from vitalspan.sources.schemas import conform


def test_supply_rules(frame):
    rows = frame([(1, None, None), (2, 0, None), (3, 7, None), (4, 7, "2001-01-03")], "i long, ds long, e string").select(
        "i", "ds", F.col("e").cast("date").alias("e"), F.lit("2001-01-01").cast("date").alias("s"))
    for rule, expected in (("plus_one_day", [2, 2, 8, 3]), ("same_day", [2, 1, 8, 3])):
        got = rows.select("i", F.dayofmonth(resolve_end("s", "e", "ds", rule)).alias("d")).orderBy("i")
        assert [r.d for r in got.collect()] == expected


def test_conform_rejects_missing_columns_and_accepts_datetimes(frame):
    df = frame([(1, "2001-01-02 03:04:05")], "person_id long, death_datetime string")
    df = df.withColumn("death_datetime", F.to_timestamp("death_datetime"))
    assert str(conform(df, "death").first().death_date) == "2001-01-02"
    with pytest.raises(ValueError):
        conform(df.drop("person_id"), "death")


def test_cohort_set_headers(spark, tmp_path):
    (tmp_path / "good.csv").write_text("cohort_id,cohort_name\n1,celecoxib\n2,celecoxibAge40\n")
    (tmp_path / "also.csv").write_text("id,name\n1,celecoxib\n")
    (tmp_path / "bad.csv").write_text("number,title\n1,celecoxib\n")
    assert store.read_cohort_set(spark, str(tmp_path / "good.csv")).count() == 2
    assert store.read_cohort_set(spark, str(tmp_path / "also.csv")).first().cohort_name == "celecoxib"
    with pytest.raises(ValueError):
        store.read_cohort_set(spark, str(tmp_path / "bad.csv"))


def test_upsert_is_idempotent(cdm, tmp_path, spark):
    path = str(tmp_path / "cohort")
    for _ in range(2):
        store.upsert_cohorts(cdm.cohort, path, [1, 2, 3, 4])
    assert sorted(map(tuple, store.read_cohorts(spark, path).collect())) == sorted(map(tuple, cdm.cohort.collect()))


def test_delete_keeps_null_conditions(frame, tmp_path):
    df = frame([(1, 5), (2, None), (3, -1)], "i long, v long")
    kept = io.delete_rows(df, "v < :floor", {"floor": 0}, str(tmp_path / "t"))
    assert sorted(r.i for r in kept.collect()) == [1, 2]


def test_pages(spark):
    pages = list(io.fetch_batches(spark.range(25), 10))
    assert [len(p) for p in pages] == [10, 10, 5]


def test_partitioned_jdbc_read_needs_bounds(spark):
    with pytest.raises(ValueError):
        io.jdbc_query(spark, "jdbc:none", "SELECT 1", partition_column="id")


def test_masking(frame):
    df = store.mask_small_counts(frame([(0,), (3,), (5,)], "n long"), ["n"], 5)
    assert [r.n for r in df.collect()] == [0, None, 5]


def test_result_tables_reject_unknown_columns(frame, tmp_path):
    with pytest.raises(ValueError):
        store.write_result(frame([(1,)], "nonsense long"), "tars", str(tmp_path))
    assert len(store.RESULT_TABLES) == 30


def test_long_id_lists_become_joins(spark):
    df = spark.range(5000).withColumnRenamed("id", "c")
    assert filter_concepts(df, "c", range(0, 3000)).count() == 3000
    assert filter_concepts(df, "c", range(0, 3000), keep=False).count() == 2000


def test_lists_of_any_length_enter_as_tables(spark):
    rows = [(i, f"name {i}") for i in range(50_000)]
    long = literal_frame(spark, rows, "id long, name string")
    assert long.count() == 50_000 and long.dtypes == literal_frame(spark, rows[:3], "id long, name string").dtypes
    assert "LocalTableScan" not in long._jdf.queryExecution().executedPlan().toString()



def test_scratch_follows_the_cluster_setting(spark):
    class Conf:
        def get(self, key, default=None):
            return "/shared/run/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert scratch_root(Session()) == "/shared/run"
    assert materialize(spark.range(3), "x").count() == 3


def test_pages_are_summed_before_the_driver_sees_them(cdm, monkeypatch):
    from vitalspan.catalog import load

    passed, fetch = [], io.fetch_batches

    def counted(df, rows):
        for page in fetch(df, rows):
            passed.append(len(page))
            yield page

    monkeypatch.setattr(io, "fetch_batches", counted)
    got = load()["fetch_batches"].plan(cdm).first()
    lines = cdm.lineitem.agg(F.count("*"), F.sum(F.col("l_quantity").cast("double"))).first()
    assert (got.rows, got.max_page_ok) == (lines[0], True) and got.quantity == pytest.approx(lines[1])
    assert sum(passed) <= lines[0] // 1000 + cdm.lineitem.rdd.getNumPartitions()


COHORT = "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date"


def cohort_rows(frame, rows):
    return frame([(d, s, "2000-01-01") for d, s in rows], "cohort_definition_id long, subject_id long, day string").selectExpr(
        "cohort_definition_id", "subject_id", "date(day) AS cohort_start_date", "date(day) + 10 AS cohort_end_date")


def stored(spark, path):
    return sorted((r.cohort_definition_id, r.subject_id) for r in store.read_cohorts(spark, path).collect())


def test_upsert_may_read_its_own_store(frame, tmp_path, spark):
    path = str(tmp_path)
    assert stored(spark, path) == []
    store.upsert_cohorts(cohort_rows(frame, [(1, 1), (1, 2), (1, 3), (2, 9)]), path, [1, 2])
    for left in ([(1, 2), (1, 3), (2, 9)], [(1, 3), (2, 9)], [(2, 9)], [(2, 9)]):
        reader = store.read_cohorts(spark, path)
        reader.count()
        store.upsert_cohorts(reader.filter(f"cohort_definition_id = 1 AND subject_id > {4 - len(left)}"), path, [1])
        assert stored(spark, path) == left
        reader.count()  # planned before the change, still readable


def test_a_killed_upsert_leaves_the_old_version(frame, tmp_path, spark, monkeypatch):
    from vitalspan.sources import snapshots

    path = str(tmp_path)
    store.upsert_cohorts(cohort_rows(frame, [(1, 1), (2, 2)]), path, [1, 2])

    def killed(self, rows, after):
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self._folder(after + 1)}/_temporary/x")
        raise KeyboardInterrupt

    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
        patch.setattr(snapshots.Snapshots, "commit", killed)
        store.upsert_cohorts(cohort_rows(frame, [(1, 7)]), path, [1])
    assert stored(spark, path) == [(1, 1), (2, 2)]
    store.upsert_cohorts(cohort_rows(frame, [(1, 8)]), path, [1])
    assert stored(spark, path) == [(1, 8), (2, 2)]


def test_versions_and_snapshots_stay_few(frame, tmp_path, spark):
    from vitalspan.sources.snapshots import Snapshots, folder_names

    path = str(tmp_path / "cohorts")
    for i in range(6):
        store.upsert_cohorts(cohort_rows(frame, [(1, i)]), path, [1])
    assert stored(spark, path) == [(1, 5)]
    assert len(folder_names(spark, f"{path}/rows")) == 2 and len(folder_names(spark, f"{path}/current")) == 2
    table = Snapshots(spark, str(tmp_path / "table"), "x long")
    table.commit(frame([(1,)], "x long"), 0)
    with pytest.raises(RuntimeError):
        table.commit(frame([(2,)], "x long"), 0)
    assert [r.x for r in table.read().collect()] == [1]
