"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalspan.catalog.registry import query
from vitalspan.catalog.common import condition_flags
from vitalspan.session import literal_frame, materialize, scratch_path
from vitalspan.sources import io, store
from vitalspan.sources.cdm import load_cdm
from vitalspan.sources.derived import RAW_TABLES


@query(
    "scan_cdm", "visit_concept_id:l visits:l people:l",
    "SELECT visit_concept_id, count(*) AS visits, count(DISTINCT person_id) AS people FROM visit_occurrence GROUP BY 1",
)
def _(cdm):
    path = scratch_path(cdm.spark, "cdm")
    cdm.visit_occurrence.write.parquet(f"{path}/visit_occurrence")
    visits = load_cdm(cdm.spark, path).visit_occurrence
    return visits.groupBy("visit_concept_id").agg(
        F.count(F.lit(1)).alias("visits"), F.countDistinct("person_id").alias("people"))


@query(
    "spill_query", "o_orderstatus:s orders:l above_mean:l",
    "SELECT o_orderstatus, count(*) AS orders, sum(CASE WHEN o_totalprice > (SELECT avg(o_totalprice) FROM orders) THEN 1 ELSE 0 END) AS above_mean FROM orders GROUP BY 1",
)
def _(cdm):
    cdm.orders.createOrReplaceTempView("spill_orders")
    kept = io.spill_query(cdm.spark, "SELECT o_orderstatus, o_totalprice FROM spill_orders")
    mean = kept.agg(F.avg("o_totalprice"))
    return kept.withColumn("high", (F.col("o_totalprice") > mean.scalar()).cast("int")).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("high").alias("above_mean"))


@query(
    "batched_apply", "l_returnflag:s rows:l revenue:f",
    "SELECT l_returnflag, count(*) AS rows, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1",
)
def _(cdm):
    def per_batch(pdf):
        pdf = pdf.assign(revenue=pdf.l_extendedprice * (1 - pdf.l_discount), rows=1)
        return pdf.groupby("l_returnflag", as_index=False)[["rows", "revenue"]].sum()

    lines = cdm.lineitem.select("l_returnflag", "l_extendedprice", "l_discount")
    parts = io.batched_apply(lines, per_batch, "l_returnflag string, rows long, revenue double")
    return parts.groupBy("l_returnflag").agg(F.sum("rows").alias("rows"), F.sum("revenue").alias("revenue"))


@query(
    "fetch_batches", "rows:l max_page_ok:b quantity:f",
    "SELECT count(*) AS rows, TRUE AS max_page_ok, sum(l_quantity) AS quantity FROM lineitem",
)
def _(cdm):
    # pages are numbered within their partition and summed in tasks; a fixed number of
    # groups of pages is what the driver fetches, however many pages there are
    limit = 1000
    place = F.monotonically_increasing_id()
    lines = cdm.lineitem.select(F.col("l_quantity").cast("double").alias("quantity"), place.alias("place"))
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    pages = lines.groupBy(part.alias("part"), F.floor(at / limit).alias("page")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity"))
    groups = pages.groupBy(F.pmod(F.xxhash64("part", "page"), F.lit(64)).alias("group")).agg(
        F.sum("rows").alias("rows"), F.max("rows").alias("largest"), F.sum("quantity").alias("quantity"))
    rows, largest, quantity = 0, 0, 0.0
    for page in io.fetch_batches(groups, 10):
        rows, largest = rows + sum(r["rows"] for r in page), max(largest, *(r["largest"] for r in page))
        quantity += sum(r["quantity"] or 0.0 for r in page)
    return literal_frame(cdm.spark, [(rows, largest <= limit, quantity)], "rows long, max_page_ok boolean, quantity double")


@query(
    "param_query", "o_orderpriority:s orders:l spent:f",
    """SELECT o_orderpriority, count(*) AS orders, sum(o_totalprice) AS spent FROM orders
       WHERE o_orderdate >= DATE '1997-01-01' AND o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1""",
)
def _(cdm):
    cdm.orders.createOrReplaceTempView("param_orders")
    hits = io.param_query(
        cdm.spark, "SELECT * FROM param_orders WHERE o_orderdate >= CAST(:since AS DATE) AND o_totalprice > :floor",
        {"since": "1997-01-01", "floor": 100000})
    return io.param_vector_query(hits, "o_orderpriority", ["1-URGENT", "5-LOW"]).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"))


@query(
    "insert_table", "n_name:s customers:l",
    "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def _(cdm):
    path = scratch_path(cdm.spark, "customers")
    low = cdm.customer.filter(F.col("c_custkey") % 2 == 0)
    high = cdm.customer.filter(F.col("c_custkey") % 2 == 1)
    io.insert_table(low, path)
    table = io.insert_table(high, path, create=False)
    return table.join(cdm.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        F.count(F.lit(1)).alias("customers"))


@query(
    "bulk_csv_load", "o_orderkey:l o_custkey:l status:s o_totalprice:f day:d",
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders",
)
def _(cdm):
    path = scratch_path(cdm.spark, "orders-csv")
    cdm.orders.select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.col("o_orderstatus")).alias("status"),
        "o_totalprice", F.col("o_orderdate").cast("date").alias("day"),
    ).write.option("header", True).option("compression", "gzip").csv(path)
    return io.bulk_csv_load(
        cdm.spark, path, "o_orderkey long, o_custkey long, status string, o_totalprice double, day date")


@query(
    "delete_rows", "s_suppkey:l s_acctbal:f",
    "SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT (s_acctbal < 0 OR s_nationkey = 3)",
)
def _(cdm):
    return io.delete_rows(cdm.supplier, "s_acctbal < :floor OR s_nationkey = :nation", {"floor": 0, "nation": 3})


@query(
    "list_tables", "table_name:s present:b rows:l",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, TRUE AS present, count(*) AS rows FROM {t}" for t in RAW_TABLES),
)
def _(cdm):
    for t in RAW_TABLES:
        getattr(cdm, t).createOrReplaceTempView(f"listed_{t}")
    out = None
    for name in io.list_tables(cdm.spark, "listed_*"):
        one = cdm.spark.table(name).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name.removeprefix("listed_")).alias("table_name"),
            F.lit(io.table_exists(cdm.spark, name)).alias("present"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "read_cohort_set", "cohort_definition_id:l cohort_name:s people:l",
    "SELECT n_nationkey AS cohort_definition_id, n_name AS cohort_name, count(c_custkey) AS people FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2",
)
def _(cdm):
    path = scratch_path(cdm.spark, "cohort-set")
    cdm.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).write.option("header", True).csv(path)
    settings = store.read_cohort_set(cdm.spark, path)
    people = cdm.customer.groupBy(F.col("c_nationkey").cast("long").alias("cohort_definition_id")).agg(
        F.count(F.lit(1)).alias("people"))
    return settings.join(people, "cohort_definition_id", "left").fillna(0, ["people"])


@query(
    "cohort_upsert", "cohort_definition_id:l subject_id:l cohort_start_date:d cohort_end_date:d",
    """SELECT * FROM cohort WHERE cohort_definition_id IN (1, 3)
       UNION ALL SELECT 2, subject_id, cohort_start_date, cohort_end_date FROM cohort WHERE cohort_definition_id = 4""",
)
def _(cdm):
    path = scratch_path(cdm.spark, "cohorts")
    store.upsert_cohorts(cdm.cohort, path, [1, 2, 3, 4])
    # definition 2 gets other rows, definition 4 becomes empty
    again = cdm.cohort.filter(F.col("cohort_definition_id") == 4).withColumn("cohort_definition_id", F.lit(2))
    store.upsert_cohorts(again, path, [2, 4])
    return store.read_cohorts(cdm.spark, path)


@query(
    "select_into", "person_id:l first_high:d days_to_next:l",
    """WITH staged AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders),
       f AS (SELECT o_custkey, min(d) AS first_high FROM staged GROUP BY 1)
       SELECT f.o_custkey AS person_id, first_high, date_diff('day', first_high, min(s.d)) AS days_to_next
       FROM f LEFT JOIN staged s ON s.o_custkey = f.o_custkey AND s.d > first_high GROUP BY 1, 2""",
)
def _(cdm):
    staged = materialize(
        cdm.orders.select(
            F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("date").alias("d")), "staged")
    first = staged.groupBy("person_id").agg(F.min("d").alias("first_high"))
    later = staged.join(first, "person_id").filter(F.col("d") > F.col("first_high"))
    nxt = later.groupBy("person_id").agg(F.min("d").alias("next"))
    return first.join(nxt, "person_id", "left").select(
        "person_id", "first_high", F.datediff("next", "first_high").alias("days_to_next"))


@query(
    "save_load_covariates", "row_id:l covariate_id:l covariate_value:f",
    """SELECT DISTINCT row_id, condition_concept_id * 1000 + 102 AS covariate_id, 1.0 AS covariate_value
       FROM cohort_rows JOIN condition_occurrence ON subject_id = person_id
       AND condition_start_date BETWEEN cohort_start_date - 365 AND cohort_start_date""",
)
def _(cdm):
    path = scratch_path(cdm.spark, "covariates")
    store.save_covariates(store.CovariateData(condition_flags(cdm, -365, 0, 102)), path)
    return store.load_covariates(cdm.spark, path, ("covariates",)).covariates


@query(
    "export_stats_csv", "cohort_definition_id:l cohort_entries:l cohort_subjects:l",
    "SELECT cohort_definition_id, count(*) AS cohort_entries, count(DISTINCT subject_id) AS cohort_subjects FROM cohort GROUP BY 1",
)
def _(cdm):
    path = scratch_path(cdm.spark, "stats")
    counts = cdm.cohort.groupBy("cohort_definition_id").agg(
        F.count(F.lit(1)).alias("cohort_entries"), F.countDistinct("subject_id").alias("cohort_subjects"))
    store.export_csv({"cohort_counts": counts}, path)
    return cdm.spark.read.option("header", True).schema(counts.schema).csv(f"{path}/cohort_counts")


@query(
    "masked_export", "condition_source_value:s people:l records:l",
    """SELECT condition_source_value, CASE WHEN people > 0 AND people < 5 THEN NULL ELSE people END AS people,
       CASE WHEN records > 0 AND records < 5 THEN NULL ELSE records END AS records
       FROM (SELECT condition_source_value, count(DISTINCT person_id) AS people, count(*) AS records FROM condition_occurrence GROUP BY 1)""",
)
def _(cdm):
    counts = cdm.condition_occurrence.groupBy("condition_source_value").agg(
        F.countDistinct("person_id").alias("people"), F.count(F.lit(1)).alias("records"))
    path = scratch_path(cdm.spark, "shared")
    store.export_csv({"counts": store.mask_small_counts(counts, ["people", "records"], 5)}, path)
    return cdm.spark.read.option("header", True).schema(counts.schema).csv(f"{path}/counts")


_TAR = "CASE WHEN cohort_definition_id = 1 THEN 365 ELSE 60 END"


@query(
    "result_store", "target_id:l tar_start_day:l tar_end_day:l tar_end_anchor:s target_count:l unique_people:l outcomes:l",
    f"""SELECT cohort_definition_id AS target_id, 1 AS tar_start_day, {_TAR} AS tar_end_day, 'cohort start' AS tar_end_anchor,
      count(*) AS target_count, count(DISTINCT subject_id) AS unique_people, sum(CASE WHEN EXISTS (SELECT 1 FROM cohort o
        WHERE o.cohort_definition_id = 3 AND o.subject_id = t.subject_id AND o.cohort_start_date > t.cohort_start_date) THEN 1 ELSE 0 END) AS outcomes
      FROM cohort t WHERE cohort_definition_id IN (1, 2, 4) GROUP BY 1""",
)
def _(cdm):
    spark, path = cdm.spark, scratch_path(cdm.spark, "results")
    last = cdm.cohort.filter(F.col("cohort_definition_id") == 3).groupBy("subject_id").agg(
        F.max("cohort_start_date").alias("_last"))
    facts = (
        cdm.cohort.filter(F.col("cohort_definition_id").isin(1, 2, 4)).join(last, "subject_id", "left")
        .groupBy(F.col("cohort_definition_id").alias("target_id"))
        .agg(
            F.count(F.lit(1)).alias("target_count"), F.countDistinct("subject_id").alias("unique_people"),
            F.sum((F.coalesce(F.col("_last") > F.col("cohort_start_date"), F.lit(False))).cast("int")).alias("outcomes"))
        .withColumn("tar_start_day", F.lit(1)).withColumn("tar_start_anchor", F.lit("cohort start"))
        .withColumn("tar_end_day", F.when(F.col("target_id") == 1, 365).otherwise(60))
        .withColumn("tar_end_anchor", F.lit("cohort start"))
    )
    facts = materialize(facts, "facts")
    tars, linked = store.surrogate_keys(
        facts, ["tar_start_day", "tar_start_anchor", "tar_end_day", "tar_end_anchor"], "tar_id")
    runs = linked.withColumn("performance_id", F.col("target_id"))
    store.write_result(tars, "tars", path)
    store.write_result(runs.select("performance_id", "target_id", "tar_id"), "performances", path, "csv")
    store.write_result(
        runs.select("performance_id", F.lit("original").alias("description"), "target_count", "unique_people", "outcomes"),
        "attrition", path)
    performances = store.read_result(spark, "performances", path, "csv")
    return (
        store.read_result(spark, "attrition", path).drop("outcome_id")
        .join(performances.select("performance_id", "target_id", "tar_id"), "performance_id")
        .join(store.read_result(spark, "tars", path), "tar_id")
    )
