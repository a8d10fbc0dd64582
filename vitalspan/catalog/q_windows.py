"""Window-style operators, ordering, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalspan.catalog.registry import query
from vitalspan.operators import ranks as R
from vitalspan.operators import sampling as M
from vitalspan.operators import sets as S
from vitalspan.operators.intervals import collapse_intervals
from vitalspan.plans import params as P

@query("event_ordinal", "o_custkey:l o_orderkey:l ordinal:l", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS ordinal FROM orders")
def _(cdm):
    rows = cdm.orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return R.row_numbers(rows, ["o_custkey"], ["day", "o_orderkey"], "ordinal")


@query("first_event_limit", "user_id:l event_id:l event_type:s value:f", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def _(cdm):
    return R.first_per_key(cdm.events.select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query("running_max", "event_id:l best:f", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def _(cdm):
    return R.running_max(cdm.events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value", "best")


@query(
    "island_ends", "subject_id:l island_end:d",
    """SELECT subject_id, day AS island_end FROM (SELECT subject_id, day, kind, sum(step) OVER (PARTITION BY subject_id ORDER BY day, kind ROWS UNBOUNDED PRECEDING) AS open_now,
         lead(kind) OVER (PARTITION BY subject_id ORDER BY day, kind) AS nxt FROM (
         SELECT subject_id, cohort_start_date AS day, 0 AS kind, count(*) AS step FROM cohort GROUP BY 1, 2 UNION ALL SELECT subject_id, cohort_end_date, 1, -count(*) FROM cohort GROUP BY 1, 2)) WHERE kind = 1 AND open_now = 0""",
)
def _(cdm):
    return collapse_intervals(cdm.cohort, ["subject_id"], "cohort_start_date", "cohort_end_date").select(
        "subject_id", F.col("cohort_end_date").alias("island_end"))


@query("earliest_end_rank", "subject_id:l cohort_start_date:d end_date:d", "SELECT subject_id, cohort_start_date, end_date FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, cohort_start_date ORDER BY cohort_end_date) AS rn, cohort_end_date AS end_date FROM cohort WHERE cohort_end_date >= cohort_start_date) WHERE rn = 1")
def _(cdm):
    valid = cdm.cohort.filter(F.col("cohort_end_date") >= F.col("cohort_start_date"))
    return valid.groupBy("subject_id", "cohort_start_date").agg(F.min("cohort_end_date").alias("end_date"))


@query("latest_value_rank", "person_id:l measurement_concept_id:l measurement_date:d unit_concept_id:l value_as_number:f", "SELECT person_id, measurement_concept_id, measurement_date, unit_concept_id, value_as_number FROM (SELECT *, row_number() OVER (PARTITION BY person_id, measurement_concept_id ORDER BY measurement_date DESC, unit_concept_id, value_as_number) AS rn FROM measurement WHERE value_as_number IS NOT NULL) WHERE rn = 1")
def _(cdm):
    m = cdm.measurement.filter(F.col("value_as_number").isNotNull()).select(
        "person_id", "measurement_concept_id", "measurement_date", "unit_concept_id", "value_as_number")
    return R.first_per_key(
        m, ["person_id", "measurement_concept_id"],
        [-F.unix_date("measurement_date"), "unit_concept_id", "value_as_number"])


@query("quantile_position", "c_nationkey:l c_custkey:l position:f", "SELECT c_nationkey, c_custkey, 1.0 * row_number() OVER (PARTITION BY c_nationkey ORDER BY n, c_custkey) / count(*) OVER (PARTITION BY c_nationkey) AS position FROM (SELECT c_nationkey, c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)")
def _(cdm):
    counts = cdm.customer.join(cdm.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.count(F.lit(1)).alias("n"))
    numbered = R.row_numbers(counts, ["c_nationkey"], ["n", "c_custkey"])
    size = counts.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("size"))
    return numbered.join(size, "c_nationkey").withColumn("position", F.col("rn") / F.col("size"))


@query("distinct_value_rn", "l_returnflag:s l_quantity:f total:l accumulated:l", "SELECT l_returnflag, l_quantity, total, sum(total) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS accumulated FROM (SELECT l_returnflag, l_quantity, count(*) AS total FROM lineitem GROUP BY 1, 2)")
def _(cdm):
    counts = cdm.lineitem.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("total"))
    return R.running_totals(counts, ["l_returnflag"], "l_quantity", ["total"]).withColumnRenamed("cum_total", "accumulated")


@query("one_code_per_concept", "target_concept_id:l source_code:s", "SELECT concept_id_2 AS target_concept_id, min(concept_code) AS source_code FROM concept_relationship JOIN concept ON concept_id = concept_id_1 WHERE vocabulary_id = 'ICD9CM' GROUP BY 1")
def _(cdm):
    from vitalspan.operators.vocab import one_code_per_concept, source_code_map
    return one_code_per_concept(source_code_map(cdm.concept, cdm.concept_relationship, "ICD9CM"))


@query("global_row_id", "row_id:l subject_id:l cohort_start_date:d", "SELECT row_number() OVER (ORDER BY subject_id, cohort_start_date) AS row_id, subject_id, cohort_start_date FROM (SELECT DISTINCT subject_id, cohort_start_date FROM cohort)")
def _(cdm):
    rows = cdm.cohort.select("subject_id", "cohort_start_date").distinct()
    return R.row_numbers(rows, [], ["subject_id", "cohort_start_date"], "row_id")


@query("first_per_concept", "person_id:l condition_concept_id:l first_date:d", "SELECT person_id, condition_concept_id, condition_start_date AS first_date FROM (SELECT *, row_number() OVER (PARTITION BY person_id, condition_concept_id ORDER BY condition_start_date) AS rn FROM condition_occurrence) WHERE rn = 1")
def _(cdm):
    return cdm.condition_occurrence.groupBy("person_id", "condition_concept_id").agg(F.min("condition_start_date").alias("first_date"))


@query("vec_rank", "l_quantity:f n:l min_rank:l max_rank:l dense:l", "SELECT l_quantity, n, COALESCE(sum(n) OVER (ORDER BY l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS min_rank, sum(n) OVER (ORDER BY l_quantity) AS max_rank, row_number() OVER (ORDER BY l_quantity) AS dense FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)")
def _(cdm):
    counts = cdm.lineitem.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1).cast("long"))
    cum = R.running_totals(counts, [], "l_quantity", ["n", "one"])
    return cum.select("l_quantity", "n", (F.col("cum_n") - F.col("n") + 1).alias("min_rank"), F.col("cum_n").alias("max_rank"), F.col("cum_one").alias("dense"))


_VIEW = "CASE WHEN event_type = 'view' THEN value END"


@query(
    "fill_missing", "event_id:l last_seen:f next_seen:f",
    f"""SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_seen,
       first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_seen FROM (SELECT *, {_VIEW} AS v FROM events)""",
)
def _(cdm):
    rows = cdm.events.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    down = R.fill_missing(rows, ["user_id"], ["ts", "event_id"], "v", "last_seen")
    return R.fill_missing(down, ["user_id"], ["ts", "event_id"], "v", "next_seen", backward=True)


@query("identify_runs", "event_id:l run_id:l", "SELECT event_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_id FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS brk FROM events)")
def _(cdm):
    return R.identify_runs(cdm.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query("top_n", "o_orderkey:l o_totalprice:f", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(cdm):
    return M.take_ordered(cdm.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 25)


@query("stable_sample_n", "subject_id:l cohort_start_date:d", "SELECT subject_id, cohort_start_date FROM cohort WHERE cohort_definition_id = 4 ORDER BY ((subject_id * month(cohort_start_date)) % 123) * ((year(cohort_start_date) * day(cohort_start_date)) % 123), subject_id, cohort_start_date LIMIT 100")
def _(cdm):
    return M.stable_sample(cdm.cohort.filter(F.col("cohort_definition_id") == 4), "subject_id", "cohort_start_date", 100)


# --- sets ----------------------------------------------------------------------
def _people(cdm, cid):
    return cdm.cohort.filter(F.col("cohort_definition_id") == cid).select("subject_id", "cohort_start_date")


_C = "SELECT subject_id, cohort_start_date FROM cohort WHERE cohort_definition_id = {}"


@query("union_all", "subject_id:l cohort_start_date:d", f"{_C.format(1)} UNION ALL {_C.format(3)} UNION ALL {_C.format(4)}")
def _(cdm):
    return S.union_all([_people(cdm, c) for c in (1, 3, 4)])


@query("union_distinct", "subject_id:l cohort_start_date:d", f"{_C.format(1)} UNION {_C.format(3)} UNION {_C.format(4)}")
def _(cdm):
    return S.union_distinct([_people(cdm, c) for c in (1, 3, 4)])


@query("intersect", "subject_id:l cohort_start_date:d", f"{_C.format(3)} INTERSECT {_C.format(4)}")
def _(cdm):
    return _people(cdm, 3).intersect(_people(cdm, 4))


@query("except", "subject_id:l cohort_start_date:d", f"{_C.format(4)} EXCEPT {_C.format(3)}")
def _(cdm):
    return _people(cdm, 4).subtract(_people(cdm, 3))


@query("bind_rows", "kind:s id:l balance:f status:s", "SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS status FROM customer UNION ALL SELECT 'order', o_orderkey, NULL, o_orderstatus FROM orders")
def _(cdm):
    return S.bind_rows([
        cdm.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")),
        cdm.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))])


@query("vec_unique", "l_orderkey:l l_linenumber:l n:l duplicated:b", "SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) > 1 AS duplicated FROM lineitem GROUP BY 1, 2")
def _(cdm):
    return S.value_tally(cdm.lineitem, ["l_orderkey", "l_linenumber"])


@query("vec_duplicate", "l_orderkey:l l_linenumber:l n:l", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(cdm):
    return S.value_tally(cdm.lineitem, ["l_orderkey", "l_linenumber"]).filter("duplicated")


@query("vec_count", "event_type:s n:l", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(cdm):
    return S.value_tally(cdm.events, ["event_type"])


@query("vec_match", "row_id:l first_event:l", "SELECT row_id, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = subject_id) AS first_event FROM cohort_rows")
def _(cdm):
    needles = cdm.cohort_rows.select("row_id", "subject_id")
    hay = cdm.orders.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("first_event"))
    return S.match_first(needles, hay, ["subject_id"], ["first_event"])


@query("locate_matches", "row_id:l days:l events:l", "SELECT row_id, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, count(*) AS events FROM cohort_rows JOIN orders ON o_custkey = subject_id AND CAST(o_orderdate AS DATE) >= cohort_start_date GROUP BY 1")
def _(cdm):
    needles = cdm.cohort_rows.select("row_id", "subject_id", "cohort_start_date")
    hay = cdm.orders.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").cast("date").alias("day"))
    daily = hay.groupBy("subject_id", "day").agg(F.count(F.lit(1)).alias("n"))
    matches = S.locate_matches(needles, daily, ["subject_id"], ("cohort_start_date", "day"))
    return matches.groupBy("row_id").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("events"))


@query(
    "fold_inclusion_events", "rule_id:l cohort_definition_id:l subject_id:l cohort_start_date:d",
    f"""SELECT r AS rule_id, cohort_definition_id, subject_id, cohort_start_date FROM cohort_rows JOIN person ON person_id = subject_id, (VALUES (0), (1), (2)) AS v(r)
      WHERE (r = 0 AND year(cohort_start_date) - year_of_birth > 40) OR (r = 1 AND gender_concept_id = {P.MALE}) OR (r = 2 AND month_of_birth > 6)""",
)
def _(cdm):
    people = cdm.cohort_rows.join(cdm.person, F.col("subject_id") == F.col("person_id"))
    rules = [F.year("cohort_start_date") - F.col("year_of_birth") > 40, F.col("gender_concept_id") == P.MALE, F.col("month_of_birth") > 6]
    return S.union_all([people.filter(r).withColumn("rule_id", F.lit(i)) for i, r in enumerate(rules)])
