"""Cohort engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalspan.catalog.oracle import islands, values
from vitalspan.catalog.registry import query
from vitalspan.operators.ranks import row_numbers
from vitalspan.operators.vocab import codeset
from vitalspan.plans import cohorts as K
from vitalspan.plans import params as P
from vitalspan.plans import study_cohorts as S
from vitalspan.session import literal_frame, materialize, scratch_path
from vitalspan.sources import store
from vitalspan.sources.derived import INGREDIENTS
from vitalspan.streaming.incremental import generate_incrementally, read_manifest

COHORT = "cohort_definition_id:l subject_id:l cohort_start_date:d cohort_end_date:d"
DRUGS = [(c, n) for _, c, n in INGREDIENTS]
FAMILY = K.drug_family(DRUGS)
_LABS = ", ".join(map(str, P.LIVER_LABS))
_RATIO = "value_as_number / NULLIF(range_high, 0)"


def _qual(fam: str, prior: int) -> str:
    return f"""SELECT cid, e.person_id, drug_era_start_date AS sd, drug_era_end_date AS ed, observation_period_start_date AS ops, observation_period_end_date AS ope
      FROM drug_era e JOIN {fam} ON drug_concept_id = concept JOIN observation_period o ON o.person_id = e.person_id
      WHERE drug_era_start_date BETWEEN observation_period_start_date AND observation_period_end_date AND observation_period_start_date + {prior} <= drug_era_start_date"""


VIEWS = {
    "fam": f"SELECT * FROM {values([(1000 + i, c) for i, (c, _) in enumerate(DRUGS)], 'cid, concept')}",
    "qual": _qual("fam", 30),
    "masked": f"""SELECT *, CASE WHEN nlab >= 2 THEN 1 ELSE 0 END + CASE WHEN nabn = 0 THEN 2 ELSE 0 END AS mask FROM (
      SELECT cid, q.person_id, sd, ed, ops, ope, count(DISTINCT measurement_concept_id) AS nlab, COALESCE(sum(CASE WHEN {_RATIO} > 1 THEN 1 ELSE 0 END), 0) AS nabn
      FROM qual q LEFT JOIN measurement m ON m.person_id = q.person_id AND measurement_concept_id IN ({_LABS}) AND measurement_date BETWEEN sd - 60 AND sd AND measurement_date BETWEEN ops AND ope
      GROUP BY ALL)""",
    "target_rows": "SELECT cid, person_id, sd, LEAST(sd + 7, ope) AS xd FROM masked WHERE mask = 3",
    "best": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid, person_id ORDER BY (mask & 1) + (mask >> 1) DESC,
      CASE WHEN mask & 1 = 1 THEN 0 WHEN mask = 2 THEN 1 ELSE 0 END, sd, ed) AS rk FROM masked) WHERE rk = 1""",
    "result": """SELECT cid, mask, count(*) AS n, 0 AS mode FROM masked GROUP BY 1, 2 UNION ALL SELECT cid, mask, count(*), 1 FROM best GROUP BY 1, 2""",
}


def _final(rows: str, gap: int) -> str:
    return f"SELECT cid AS cohort_definition_id, person_id AS subject_id, s AS cohort_start_date, e AS cohort_end_date FROM ({islands(rows, 'cid, person_id', 'sd', 'xd', gap)})"


def _lab_cohort(cid: int, days: str, gap: int = 0) -> str:
    """days: SELECT person_id, sd of entry measurements."""
    rows = f"""(SELECT DISTINCT {cid} AS cid, d.person_id, sd, LEAST(sd + 7, observation_period_end_date) AS xd FROM ({days}) d JOIN observation_period o ON o.person_id = d.person_id
      AND sd BETWEEN observation_period_start_date AND observation_period_end_date)"""
    return _final(rows, gap)


def _m(where: str) -> str:
    return f"SELECT person_id, measurement_date AS sd FROM measurement WHERE {where}"


_PAIRED = f"""SELECT b.person_id, b.measurement_date AS sd FROM measurement b JOIN measurement a ON a.person_id = b.person_id JOIN observation_period o ON o.person_id = b.person_id
  AND b.measurement_date BETWEEN observation_period_start_date AND observation_period_end_date AND a.measurement_date BETWEEN observation_period_start_date AND observation_period_end_date
  WHERE b.measurement_concept_id = {P.BILIRUBIN} AND b.{_RATIO.replace('NULLIF(', 'NULLIF(b.')} > 2 AND a.measurement_concept_id = {P.ALT} AND a.{_RATIO.replace('NULLIF(', 'NULLIF(a.')} > 3
  AND abs(date_diff('day', a.measurement_date, b.measurement_date)) <= 7"""
_A_DAYS = f"{_m(f'(measurement_concept_id = {P.ALT} AND {_RATIO} > 5) OR (measurement_concept_id = {P.ALP} AND {_RATIO} > 2)')} UNION {_PAIRED}"
_B_DAYS = _m(f"(measurement_concept_id IN ({P.AST}, {P.ALT}) AND ({_RATIO} > 3 OR value_as_number > 200)) OR (measurement_concept_id IN ({P.ALP}, {P.BILIRUBIN}) AND {_RATIO} > 2)")
_R_DAYS = _m(f"measurement_concept_id IN ({', '.join(map(str, P.RENAL_MARKERS))}) AND value_as_number > 1.2")


@query(
    "codeset", "codeset_id:l concept_id:l",
    f"""SELECT 1 AS codeset_id, concept_id FROM (VALUES ({P.ALT}), ({P.AST})) AS v(concept_id)
      UNION ALL SELECT 2, descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id IN ({P.DRUGS['losartan']}, {P.DRUGS['naproxen']}) AND descendant_concept_id NOT IN
        (SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id = 3000002)""",
)
def _(cdm):
    labs = codeset(cdm.concept_ancestor, [P.ALT, P.AST]).withColumn("codeset_id", F.lit(1))
    drugs = codeset(
        cdm.concept_ancestor, [P.DRUGS["losartan"], P.DRUGS["naproxen"]], include_descendants=True, exclude_ids=[3000002])
    return labs.unionByName(drugs.withColumn("codeset_id", F.lit(2)))


@query(
    "primary_drug_era", "cohort_definition_id:l person_id:l start_date:d end_date:d",
    "SELECT cid AS cohort_definition_id, person_id, drug_era_start_date AS start_date, drug_era_end_date AS end_date FROM drug_era JOIN fam ON drug_concept_id = concept", VIEWS,
)
def _(cdm):
    return K.drug_events(cdm, FAMILY)


@query(
    "primary_first_exposure", "cohort_definition_id:l person_id:l start_date:d end_date:d",
    "SELECT cid AS cohort_definition_id, person_id, min(drug_era_start_date) AS start_date, min(drug_era_end_date) AS end_date FROM drug_era JOIN fam ON drug_concept_id = concept GROUP BY 1, 2", VIEWS,
)
def _(cdm):
    return K.entry_events(cdm, [K.liver_target(1000 + i, n, c, 60, first_only=True) for i, (c, n) in enumerate(DRUGS)])


@query(
    "primary_measurement", "person_id:l start_date:d end_date:d n:l",
    f"SELECT person_id, sd AS start_date, sd + 1 AS end_date, count(*) AS n FROM ({_R_DAYS}) GROUP BY 1, 2",
)
def _(cdm):
    return K.entry_events(cdm, [K.renal_outcome()])


@query(
    "primary_compound", "person_id:l start_date:d",
    f"SELECT DISTINCT person_id, sd AS start_date FROM ({_A_DAYS})",
)
def _(cdm):
    return K.entry_events(cdm, [K.liver_outcome_a()])


@query("primary_death", "person_id:l start_date:d end_date:d", "SELECT person_id, death_date AS start_date, death_date + 1 AS end_date FROM death")
def _(cdm):
    return K.entry_events(cdm, [K.CohortDefinition(300, "death", K.DeathEntry())])


@query(
    "qualified_events", "cohort_definition_id:l person_id:l event_id:l start_date:d end_date:d op_start_date:d op_end_date:d",
    "SELECT cid AS cohort_definition_id, person_id, row_number() OVER (PARTITION BY cid, person_id ORDER BY sd) AS event_id, sd AS start_date, ed AS end_date, ops AS op_start_date, ope AS op_end_date FROM qual", VIEWS,
)
def _(cdm):
    events = K.qualified_events(cdm, FAMILY).select(*K.EVENT)
    return row_numbers(events, ["cohort_definition_id", "person_id"], ["start_date"], "event_id")


_EVENT_OUT = "cohort_definition_id:l person_id:l start_date:d"
_EVENT_SQL = "SELECT cid AS cohort_definition_id, person_id, sd AS start_date FROM"


@query("rule_measured_at_least_k", _EVENT_OUT, f"{_EVENT_SQL} masked WHERE nlab >= 2", VIEWS)
def _(cdm):
    return K.rule_flags(cdm, K.qualified_events(cdm, FAMILY), FAMILY[0].rules[:1]).filter("rule_0")


@query("rule_all_normal", _EVENT_OUT, f"{_EVENT_SQL} masked WHERE nabn = 0", VIEWS)
def _(cdm):
    return K.rule_flags(cdm, K.qualified_events(cdm, FAMILY), FAMILY[0].rules[1:]).filter("rule_0")


RENAL = [K.renal_target(2000 + i, n, c) for i, (c, n) in enumerate(DRUGS)]
_RENAL = {
    **VIEWS, "rfam": f"SELECT * FROM {values([(2000 + i, c) for i, (c, _) in enumerate(DRUGS)], 'cid, concept')}",
    "rqual": _qual("rfam", 30),
    "rmask": f"""SELECT cid, q.person_id, sd, ed, ops, ope, count(measurement_date) AS ncr, COALESCE(sum(CASE WHEN value_as_number < 1.2 THEN 1 ELSE 0 END), 0) AS nlow FROM rqual q
      LEFT JOIN measurement m ON m.person_id = q.person_id AND measurement_concept_id = {P.CREATININE} AND measurement_date BETWEEN sd - 60 AND sd AND measurement_date BETWEEN ops AND ope GROUP BY ALL""",
}


@query("rule_renal_measured_twice", _EVENT_OUT, f"{_EVENT_SQL} rmask WHERE ncr >= 2", _RENAL)
def _(cdm):
    return K.rule_flags(cdm, K.qualified_events(cdm, RENAL), RENAL[0].rules[:1]).filter("rule_0")


@query("rule_renal_normal", _EVENT_OUT, f"{_EVENT_SQL} rmask WHERE nlow = 0", _RENAL)
def _(cdm):
    return K.rule_flags(cdm, K.qualified_events(cdm, RENAL), RENAL[0].rules[1:]).filter("rule_0")


TRIO = K.first_drug_cohorts(P.DRUGS["celecoxib"])
_TRIO_EVENTS = f"""(SELECT e.person_id, e.sd, ope, year(sd) - year_of_birth AS age, gender_concept_id AS g FROM
  (SELECT person_id, min(drug_era_start_date) AS sd FROM drug_era WHERE drug_concept_id = {P.DRUGS['celecoxib']} GROUP BY 1) e
  JOIN (SELECT person_id, observation_period_start_date AS ops, observation_period_end_date AS ope FROM observation_period) o ON o.person_id = e.person_id AND sd BETWEEN ops AND ope
  JOIN person p ON p.person_id = e.person_id)"""
_TRIO_SQL = " UNION ALL ".join(
    f"SELECT {i} AS cohort_definition_id, person_id AS subject_id, sd AS cohort_start_date, ope AS cohort_end_date FROM {_TRIO_EVENTS} WHERE {w}"
    for i, w in ((1, "TRUE"), (2, "age > 40"), (3, f"age > 40 AND g = {P.MALE}")))


@query("rule_demographic", COHORT, _TRIO_SQL)
def _(cdm):
    return K.build_cohorts(cdm, TRIO)


@query(
    "included_events", "cohort_definition_id:l person_id:l start_date:d end_date:d",
    "SELECT cid AS cohort_definition_id, person_id, min(sd) AS start_date, min_by(ed, sd) AS end_date FROM masked WHERE mask = 3 GROUP BY 1, 2", VIEWS,
)
def _(cdm):
    from dataclasses import replace
    family = [replace(d, included_first_only=True) for d in FAMILY]
    return K.included(K.masked_events(cdm, family), family[0])


@query(
    "exit_fixed_offset", "cohort_definition_id:l person_id:l start_date:d exit_date:d",
    "SELECT cid AS cohort_definition_id, person_id, sd AS start_date, LEAST(sd + 7, ope) AS exit_date FROM qual", VIEWS,
)
def _(cdm):
    return K.exit_fixed_offset(K.qualified_events(cdm, FAMILY), 7)


@query(
    "exit_obs_end", "cohort_definition_id:l person_id:l start_date:d exit_date:d",
    "SELECT cid AS cohort_definition_id, person_id, sd AS start_date, ope AS exit_date FROM qual", VIEWS,
)
def _(cdm):
    return K.exit_observation_end(K.qualified_events(cdm, FAMILY))


@query("final_cohort", COHORT, f"{_lab_cohort(101, _B_DAYS)} UNION ALL {_lab_cohort(200, _R_DAYS, 30)}")
def _(cdm):
    return K.build_cohorts(cdm, [K.liver_outcome_b(), K.renal_outcome()])


@query("cohort_family", COHORT, _final("target_rows", 0), VIEWS)
def _(cdm):
    return K.build_family(cdm, FAMILY)


STUDY = [*FAMILY, K.liver_outcome_a(), K.liver_outcome_b(), *RENAL[4:6], K.renal_outcome(), *TRIO]
_ALL = f"""{_final('target_rows', 0)} UNION ALL {_lab_cohort(100, _A_DAYS)} UNION ALL {_lab_cohort(101, _B_DAYS)} UNION ALL {_lab_cohort(200, _R_DAYS, 30)}
  UNION ALL {_final('(SELECT cid, person_id, sd, LEAST(sd + 7, ope) AS xd FROM rmask WHERE ncr >= 2 AND nlow = 0 AND cid IN (2004, 2005))', 0)} UNION ALL {_TRIO_SQL}"""
_NAMES = [(d.cohort_definition_id, d.name) for d in STUDY]


@query(
    "generate_cohort_set", "cohort_definition_id:l cohort_name:s cohort_entries:l cohort_subjects:l",
    f"""SELECT cohort_definition_id, nm AS cohort_name, count(*) AS cohort_entries, count(DISTINCT subject_id) AS cohort_subjects FROM ({_ALL}) JOIN {values(_NAMES, 'id, nm')} ON id = cohort_definition_id GROUP BY 1, 2""", _RENAL,
)
def _(cdm):
    path = scratch_path(cdm.spark, "cohorts")
    cdm.pin("drug_era")
    built = materialize(K.build_cohorts(cdm, STUDY), "study")
    store.upsert_cohorts(built, path, [d.cohort_definition_id for d in STUDY])
    names = literal_frame(cdm.spark, [(i, c, n) for i, (c, n) in enumerate(_NAMES)], "seq int, cohort_definition_id long, cohort_name string")
    return K.named_counts(K.cohort_counts(store.read_cohorts(cdm.spark, path)), names)


@query(
    "custom_covariate_cohorts", "cohort_definition_id:l entries:l",
    f"SELECT cohort_definition_id, count(*) AS entries FROM ({_lab_cohort(100, _A_DAYS)} UNION ALL {_lab_cohort(200, _R_DAYS, 30)}) GROUP BY 1",
)
def _(cdm):
    extra = K.unique_definitions([K.liver_outcome_a(), K.renal_outcome(), K.liver_outcome_a()])
    return K.build_cohorts(cdm, extra).groupBy("cohort_definition_id").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "cohort_incremental", "cohort_definition_id:l run:l entries:l",
    f"""SELECT cohort_definition_id, CASE cohort_definition_id WHEN 101 THEN 1 ELSE 2 END AS run, count(*) AS entries FROM (
      {_lab_cohort(100, _A_DAYS)} UNION ALL {_lab_cohort(101, _B_DAYS)} UNION ALL {_lab_cohort(200, _R_DAYS, 0)}) GROUP BY 1""",
)
def _(cdm):
    from dataclasses import replace
    folder = scratch_path(cdm.spark, "incremental")
    generate_incrementally(cdm, [K.liver_outcome_b(), K.renal_outcome()], folder)
    changed = replace(K.renal_outcome(), gap_days=0)
    generate_incrementally(cdm, [K.liver_outcome_a(), K.liver_outcome_b(), changed], folder)
    generate_incrementally(cdm, [K.liver_outcome_a(), K.liver_outcome_b(), changed], folder)
    runs = read_manifest(cdm.spark, folder).groupBy("cohort_definition_id").agg(F.max("run").alias("run"))
    counts = store.read_cohorts(cdm.spark, f"{folder}/cohort").groupBy("cohort_definition_id").agg(
        F.count(F.lit(1)).alias("entries"))
    return runs.join(counts, "cohort_definition_id")


_STATS = """SELECT 'inclusion_result' AS stat, cid AS cohort_definition_id, mode AS mode_id, mask AS id, n AS person_count, CAST(NULL AS BIGINT) AS gain_count, CAST(NULL AS BIGINT) AS total FROM result
  UNION ALL SELECT 'inclusion_stats', cid, mode, r, sum(CASE WHEN (mask >> r) & 1 = 1 THEN n ELSE 0 END), sum(CASE WHEN mask = 3 - (1 << r) THEN n ELSE 0 END), sum(n) FROM result, (VALUES (0), (1)) AS v(r) GROUP BY 2, 3, 4
  UNION ALL SELECT 'summary_stats', cid, mode, 0, sum(CASE WHEN mask = 3 THEN n ELSE 0 END), NULL, sum(n) FROM result GROUP BY 2, 3"""


_RULE_NAMES = values([(d.cohort_definition_id, i, r.label()) for d in FAMILY for i, r in enumerate(d.rules)], "cid2, place, nm")


@query("inclusion_rules", "cohort_definition_id:l rule_sequence:l name:s mode_id:l person_count:l",
       f"SELECT cohort_definition_id, id AS rule_sequence, nm AS name, mode_id, person_count FROM ({_STATS}) s JOIN {_RULE_NAMES} ON cid2 = cohort_definition_id AND place = id WHERE stat = 'inclusion_stats'", VIEWS)
def _(cdm):
    stats = K.cohort_stats(K.masked_events(cdm, FAMILY), 2)["inclusion_stats"]
    names = K.inclusion_rules(cdm.spark, FAMILY)
    return stats.join(names, ["cohort_definition_id", "rule_sequence"])


@query("cohort_stats", "stat:s cohort_definition_id:l mode_id:l id:l person_count:l gain_count:l total:l", _STATS, VIEWS)
def _(cdm):
    stats = K.cohort_stats(K.masked_events(cdm, FAMILY), 2)
    r = stats["inclusion_result"]
    null = F.lit(None).cast("long")
    return (
        r.select(F.lit("inclusion_result").alias("stat"), "cohort_definition_id", "mode_id", F.col("inclusion_rule_mask").alias("id"),
                 "person_count", null.alias("gain_count"), null.alias("total"))
        .unionByName(stats["inclusion_stats"].select(
            F.lit("inclusion_stats").alias("stat"), "cohort_definition_id", "mode_id", F.col("rule_sequence").cast("long").alias("id"),
            "person_count", "gain_count", F.col("person_total").alias("total")))
        .unionByName(stats["summary_stats"].select(
            F.lit("summary_stats").alias("stat"), "cohort_definition_id", "mode_id", F.lit(0).cast("long").alias("id"),
            F.col("final_count").alias("person_count"), null.alias("gain_count"), F.col("base_count").alias("total"))))


@query("inclusion_mask", "cohort_definition_id:l person_id:l start_date:d inclusion_rule_mask:l", "SELECT cid AS cohort_definition_id, person_id, sd AS start_date, mask AS inclusion_rule_mask FROM masked", VIEWS)
def _(cdm):
    return K.masked_events(cdm, FAMILY)


@query("inclusion_result", "cohort_definition_id:l inclusion_rule_mask:l person_count:l mode_id:l", "SELECT cid AS cohort_definition_id, mask AS inclusion_rule_mask, n AS person_count, mode AS mode_id FROM result", VIEWS)
def _(cdm):
    return K.inclusion_result(K.masked_events(cdm, FAMILY))


@query(
    "inclusion_gain_stats", "cohort_definition_id:l mode_id:l rule_sequence:l person_count:l gain_count:l person_total:l",
    "SELECT cid AS cohort_definition_id, mode AS mode_id, r AS rule_sequence, sum(CASE WHEN (mask >> r) & 1 = 1 THEN n ELSE 0 END) AS person_count, sum(CASE WHEN mask = 3 - (1 << r) THEN n ELSE 0 END) AS gain_count, sum(n) AS person_total FROM result, (VALUES (0), (1)) AS v(r) GROUP BY 1, 2, 3", VIEWS,
)
def _(cdm):
    return K.inclusion_stats(K.inclusion_result(K.masked_events(cdm, FAMILY)), 2)


@query(
    "cohort_summary_stats", "cohort_definition_id:l mode_id:l base_count:l final_count:l",
    "SELECT cid AS cohort_definition_id, mode AS mode_id, sum(n) AS base_count, sum(CASE WHEN mask = 3 THEN n ELSE 0 END) AS final_count FROM result GROUP BY 1, 2", VIEWS,
)
def _(cdm):
    return K.summary_stats(K.inclusion_result(K.masked_events(cdm, FAMILY)), 2)


@query("best_event_rank", "cohort_definition_id:l person_id:l start_date:d inclusion_rule_mask:l", "SELECT cid AS cohort_definition_id, person_id, sd AS start_date, mask AS inclusion_rule_mask FROM best", VIEWS)
def _(cdm):
    return K.best_events(K.masked_events(cdm, FAMILY))


_CENSORED = "SELECT * FROM (SELECT cohort_definition_id, subject_id, cohort_start_date, COALESCE(LEAST(cohort_end_date, death_date), cohort_end_date) AS xd FROM cohort LEFT JOIN death ON person_id = subject_id) WHERE xd >= cohort_start_date"


@query(
    "censor_stats", "cohort_definition_id:l lost_count:l",
    f"SELECT a.cohort_definition_id, n - COALESCE(k, 0) AS lost_count FROM (SELECT cohort_definition_id, count(*) AS n FROM cohort GROUP BY 1) a LEFT JOIN (SELECT cohort_definition_id, count(*) AS k FROM ({_CENSORED}) GROUP BY 1) b ON a.cohort_definition_id = b.cohort_definition_id",
)
def _(cdm):
    return K.censor_stats(cdm.cohort, K.censor_at(cdm.cohort, cdm.death, "person_id", "death_date"))


_NC = [(901, 5000001), (902, 4000007), (903, 5000003)]


@query(
    "negative_control", "kind:s " + COHORT,
    f"""SELECT 'first' AS kind, id AS cohort_definition_id, person_id AS subject_id, min(condition_start_date) AS cohort_start_date, min(condition_start_date) AS cohort_end_date FROM condition_occurrence
        JOIN (SELECT DISTINCT id, descendant_concept_id AS d FROM {values(_NC, 'id, c')} JOIN concept_ancestor ON ancestor_concept_id = c) ON d = condition_concept_id GROUP BY 2, 3
      UNION ALL SELECT 'all', id, person_id, condition_start_date, condition_start_date FROM condition_occurrence JOIN {values(_NC, 'id, c')} ON c = condition_concept_id""",
)
def _(cdm):
    first = S.negative_controls(cdm, _NC, True, "first").withColumn("kind", F.lit("first"))
    return first.unionByName(S.negative_controls(cdm, _NC, False, "all").withColumn("kind", F.lit("all")))


_NU = (P.DRUGS["celecoxib"], P.DRUGS["diclofenac"])


@query(
    "new_user_cohort", COHORT,
    f"""SELECT drug_concept_id AS cohort_definition_id, f.person_id AS subject_id, sd AS cohort_start_date, ed AS cohort_end_date FROM
      (SELECT drug_concept_id, person_id, min(drug_era_start_date) AS sd, min(drug_era_end_date) AS ed FROM drug_era WHERE drug_concept_id IN {_NU} GROUP BY 1, 2) f
      JOIN observation_period o ON o.person_id = f.person_id AND sd >= observation_period_start_date AND ed <= observation_period_end_date WHERE date_diff('day', observation_period_start_date, sd) >= 365""",
)
def _(cdm):
    return S.new_user_cohorts(cdm, _NU)


_T2DM = f"""SELECT v.person_id, min(visit_start_date) AS sd FROM visit_occurrence v
  JOIN (SELECT person_id, min(condition_start_date) AS onset FROM condition_occurrence JOIN concept_ancestor ON descendant_concept_id = condition_concept_id AND ancestor_concept_id = {P.TYPE_2_DIABETES} GROUP BY 1) dm ON dm.person_id = v.person_id AND onset + 90 < visit_start_date
  JOIN observation_period o ON o.person_id = v.person_id AND observation_period_start_date + 90 < visit_start_date AND visit_start_date + 60 < observation_period_end_date
  WHERE visit_concept_id = 9201 OR visit_concept_id = 9203 GROUP BY 1"""
_READMIT = f"SELECT 2 AS cohort_definition_id, v.person_id AS subject_id, visit_start_date AS cohort_start_date, visit_end_date AS cohort_end_date FROM ({_T2DM}) t JOIN visit_occurrence v ON v.person_id = t.person_id AND visit_concept_id IN (9201, 9203) AND visit_start_date > sd AND visit_start_date <= sd + 60"


@query("t2dm_hospitalisation", COHORT, f"SELECT 1 AS cohort_definition_id, person_id AS subject_id, sd AS cohort_start_date, sd + 60 AS cohort_end_date FROM ({_T2DM}) UNION ALL {_READMIT}")
def _(cdm):
    return S.t2dm_hospitalisation(cdm, 90, 60)


@query("readmission_join", COHORT, _READMIT)
def _(cdm):
    return S.t2dm_hospitalisation(cdm, 90, 60).filter(F.col("cohort_definition_id") == 2)


_STROKE_SET = """(SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id = 443454
  UNION SELECT descendant_concept_id FROM concept_ancestor WHERE descendant_concept_id IN (375557, 372924, 441874))"""
_STROKE = f"""SELECT 2 AS cohort_definition_id, person_id AS subject_id, visit_start_date AS cohort_start_date, visit_end_date AS cohort_end_date FROM visit_occurrence v WHERE visit_concept_id IN (262, 9201)
  AND EXISTS (SELECT 1 FROM condition_occurrence c WHERE c.person_id = v.person_id AND condition_start_date BETWEEN visit_start_date AND visit_end_date AND condition_concept_id IN {_STROKE_SET}) GROUP BY ALL"""
_AF = f"""SELECT 1 AS cohort_definition_id, a.person_id AS subject_id, sd AS cohort_start_date, observation_period_end_date AS cohort_end_date FROM
  (SELECT person_id, min(condition_start_date) AS sd FROM condition_occurrence WHERE condition_concept_id IN (SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id = {P.ATRIAL_FIBRILLATION}) GROUP BY 1) a
  JOIN observation_period o ON o.person_id = a.person_id AND sd >= observation_period_start_date + 180 AND sd <= observation_period_end_date
  WHERE NOT EXISTS (SELECT 1 FROM drug_exposure d WHERE d.person_id = a.person_id AND drug_exposure_start_date < sd AND drug_concept_id IN (SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id = {P.DRUGS['warfarin']}))"""


@query("af_stroke_cohorts", COHORT, f"{_AF} UNION ALL {_STROKE}")
def _(cdm):
    return S.af_stroke_cohorts(cdm, 180)


@query("new_user_anti", COHORT, _AF)
def _(cdm):
    return S.af_stroke_cohorts(cdm, 180).filter(F.col("cohort_definition_id") == 1)


@query("visit_containment_outcome", COHORT, _STROKE)
def _(cdm):
    return S.af_stroke_cohorts(cdm, 180).filter(F.col("cohort_definition_id") == 2)


_ACE = ", ".join(map(str, P.ACE_INHIBITORS))


@query(
    "ace_angioedema_cohorts", COHORT,
    f"""SELECT 1 AS cohort_definition_id, a.person_id AS subject_id, sd AS cohort_start_date, observation_period_end_date AS cohort_end_date FROM
        (SELECT person_id, min(drug_exposure_start_date) AS sd FROM drug_exposure WHERE drug_concept_id IN (SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id IN ({_ACE})) GROUP BY 1) a
        JOIN observation_period o ON o.person_id = a.person_id AND sd >= observation_period_start_date + 364 AND sd <= observation_period_end_date
      UNION ALL SELECT 2, person_id, condition_start_date, condition_start_date FROM condition_occurrence WHERE condition_concept_id IN (SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id = {P.ANGIOEDEMA})""",
)
def _(cdm):
    return S.ace_angioedema_cohorts(cdm)
