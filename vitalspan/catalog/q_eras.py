"""Era building and interval algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalspan.catalog.oracle import islands
from vitalspan.catalog.registry import query
from vitalspan.operators.eras import drug_era, ingredient_exposures, sub_exposures
from vitalspan.operators.intervals import (
    collapse_intervals, interval_difference, interval_intersection, interval_union,
)


@query(
    "sub_exposures", "person_id:l drug_concept_id:l start_date:d end_date:d drug_exposure_count:l",
    "SELECT person_id, ing AS drug_concept_id, s AS start_date, e AS end_date, n AS drug_exposure_count FROM sub_exposure",
)
def _(cdm):
    return sub_exposures(ingredient_exposures(cdm.drug_exposure, cdm.concept, cdm.concept_ancestor))


@query(
    "days_exposed", "drug_concept_id:l sub_exposures:l days_exposed:l",
    "SELECT ing AS drug_concept_id, count(*) AS sub_exposures, sum(date_diff('day', s, e)) AS days_exposed FROM sub_exposure GROUP BY ing",
)
def _(cdm):
    subs = sub_exposures(ingredient_exposures(cdm.drug_exposure, cdm.concept, cdm.concept_ancestor))
    return subs.groupBy("drug_concept_id").agg(
        F.count(F.lit(1)).alias("sub_exposures"), F.sum("days_exposed").alias("days_exposed"))


# The reference statement works on boundary events: a running open-interval
# count that drops to zero ends an island.
_OPEN_COUNT = """
  SELECT person_id, ing AS drug_concept_id, min(sd) AS drug_era_start_date, max(ed) AS drug_era_end_date,
    sum(k) AS drug_exposure_count, date_diff('day', min(sd), max(ed)) - sum(x) AS gap_days
  FROM (SELECT *, sum(CASE WHEN kind = 0 AND open_before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id, ing ORDER BY day, kind, id ROWS UNBOUNDED PRECEDING) AS island
    FROM (SELECT *, sum(CASE WHEN kind = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY person_id, ing ORDER BY day, kind, id ROWS UNBOUNDED PRECEDING)
        - CASE WHEN kind = 0 THEN 1 ELSE -1 END AS open_before
      FROM (SELECT person_id, ing, s AS day, 0 AS kind, s AS sd, e AS ed, n AS k, date_diff('day', s, e) AS x, row_number() OVER () AS id FROM sub_exposure
        UNION ALL SELECT person_id, ing, e + 30, 1, NULL, NULL, 0, 0, row_number() OVER () FROM sub_exposure)))
  WHERE kind = 0 GROUP BY person_id, ing, island"""


@query(
    "drug_era",
    "person_id:l drug_concept_id:l drug_era_start_date:d drug_era_end_date:d drug_exposure_count:l gap_days:l",
    _OPEN_COUNT,
)
def _(cdm):
    return drug_era(cdm.drug_exposure, cdm.concept, cdm.concept_ancestor)


@query(
    "collapse_cohort", "gap:l subject_id:l cohort_start_date:d cohort_end_date:d",
    " UNION ALL ".join(
        f"SELECT {g} AS gap, subject_id, s AS cohort_start_date, e AS cohort_end_date FROM ("
        + islands("(SELECT subject_id, cohort_start_date, cohort_end_date FROM cohort WHERE cohort_definition_id = 4)",
                  "subject_id", "cohort_start_date", "cohort_end_date", g) + ")" for g in (0, 30)),
)
def _(cdm):
    rows = cdm.cohort.filter(F.col("cohort_definition_id") == 4)
    parts = [
        collapse_intervals(rows, ["subject_id"], "cohort_start_date", "cohort_end_date", g).withColumn("gap", F.lit(g))
        for g in (0, 30)
    ]
    return parts[0].unionByName(parts[1])


def _days(cid: int) -> str:
    return ("SELECT DISTINCT subject_id, CAST(unnest(generate_series(cohort_start_date, cohort_end_date, INTERVAL 1 DAY)) AS DATE) AS day "
            f"FROM cohort WHERE cohort_definition_id = {cid}")


def _runs(op: str, sets: str) -> str:
    return f"""SELECT '{op}' AS op, subject_id, min(day) AS start_date, max(day) AS end_date FROM (
      SELECT subject_id, day, date_diff('day', DATE '1970-01-01', day) - row_number() OVER (PARTITION BY subject_id ORDER BY day) AS g FROM ({sets}))
      GROUP BY subject_id, g"""


@query(
    "interval_algebra", "op:s subject_id:l start_date:d end_date:d",
    " UNION ALL ".join(
        _runs(op, f"SELECT * FROM ({_days(1)}) {kw} SELECT * FROM ({_days(4)})")
        for op, kw in (("union", "UNION"), ("intersection", "INTERSECT"), ("difference", "EXCEPT"))),
)
def _(cdm):
    def part(cid):
        return cdm.cohort.filter(F.col("cohort_definition_id") == cid).select(
            "subject_id", F.col("cohort_start_date").alias("start_date"), F.col("cohort_end_date").alias("end_date"))

    a, b = part(1), part(4)
    ops = {"union": interval_union, "intersection": interval_intersection, "difference": interval_difference}
    frames = [
        fn(a, b, ["subject_id"], "start_date", "end_date").withColumn("op", F.lit(op)) for op, fn in ops.items()
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
