import pytest
from pyspark.sql import functions as F

from vitalspan import session
from vitalspan.plans import cohorts as K
from vitalspan.plans import params as P


def masked(frame, masks):
    rows = [(1, i, m, 1) for i, m in enumerate(masks)]
    df = frame(rows, "cohort_definition_id long, person_id long, inclusion_rule_mask long, n long")
    day = F.lit("2001-01-01").cast("date")
    return df.select("*", *[day.alias(c) for c in ("start_date", "end_date", "op_start_date", "op_end_date")])


def test_mask_statistics(frame):
    m = masked(frame, [0, 1, 1, 2, 3, 3, 3])
    result = K.inclusion_result(m)
    events = {r.inclusion_rule_mask: r.person_count for r in result.filter("mode_id = 0").collect()}
    assert events == {0: 1, 1: 2, 2: 1, 3: 3}
    stats = {r.rule_sequence: (r.person_count, r.gain_count, r.person_total) for r in K.inclusion_stats(result, 2).filter("mode_id = 0").collect()}
    assert stats == {0: (5, 1, 7), 1: (4, 2, 7)}
    s = K.summary_stats(result, 2).filter("mode_id = 0").first()
    assert (s.base_count, s.final_count) == (7, 3)


def test_best_event_prefers_more_rules_then_earliest_rule(frame):
    df = frame(
        [(1, 7, m, d) for m, d in ((2, "2001-01-01"), (1, "2001-02-01"), (1, "2001-03-01"))],
        "cohort_definition_id long, person_id long, inclusion_rule_mask long, d string")
    day = F.col("d").cast("date")
    df = df.select("*", F.lit(1).alias("n"), *[day.alias(c) for c in ("start_date", "end_date", "op_start_date", "op_end_date")])
    best = K.best_events(df).first()
    assert (best.inclusion_rule_mask, str(best.start_date)) == (1, "2001-02-01")


def test_missing_limit_is_never_abnormal(frame):
    df = frame([(1, 90.0, None), (2, 90.0, 0.0), (3, 90.0, 30.0), (4, 30.0, 30.0)], "i long, value_as_number double, range_high double")
    test = K.LabTest((5,), ratio=(">", 1.0))
    hit = df.withColumn("measurement_concept_id", F.lit(5)).filter(test.matches())
    assert [r.i for r in hit.collect()] == [3]


def test_family_equals_single_builds(cdm):
    family = K.drug_family([(P.DRUGS["losartan"], "losartan"), (P.DRUGS["naproxen"], "naproxen")])
    assert len(K.families(family)) == 1
    together = sorted(map(tuple, K.build_cohorts(cdm, family).collect()))
    apart = sorted(tuple(r) for d in family for r in K.build_cohorts(cdm, [d]).collect())
    assert together == apart and together


def test_groups_nest(cdm):
    each = tuple(K.Criterion(K.LabTest((c,))) for c in P.LIVER_LABS)
    rules = [K.LabRule(each, "all"), K.LabRule(each, "at_least", 2), K.LabRule(each, "any")]
    flagged = K.rule_flags(cdm, K.qualified_events(cdm, K.drug_family([(P.DRUGS["losartan"], "x")])), rules)
    assert flagged.filter("rule_0 AND NOT rule_1").count() == 0
    assert flagged.filter("rule_1 AND NOT rule_2").count() == 0


def test_renal_comparator_is_a_parameter(cdm):
    strict, sane = (K.renal_target(1, "x", P.DRUGS["losartan"], s) for s in (True, False))
    assert strict.template() != sane.template()


def test_checksum_changes_with_definition():
    a = K.renal_outcome()
    from dataclasses import replace
    assert a.checksum() == K.renal_outcome().checksum() != replace(a, gap_days=0).checksum()


def test_incremental_runs_only_what_changed(cdm, tmp_path):
    from vitalspan.streaming.incremental import generate_incrementally
    a, b = K.renal_outcome(), K.liver_outcome_b()
    assert generate_incrementally(cdm, [a], str(tmp_path)) == [200]
    assert generate_incrementally(cdm, [a, b], str(tmp_path)) == [101]
    assert generate_incrementally(cdm, [a, b], str(tmp_path)) == []


@pytest.mark.parametrize("first", [True, False])
def test_first_only_keeps_one_row_per_person(cdm, first):
    d = K.CohortDefinition(1, "x", K.DrugEntry((P.DRUGS["losartan"],)), first_only=first, exit_days=None)
    rows = K.entry_events(cdm, [d])
    assert (rows.groupBy("person_id").count().filter("count > 1").count() == 0) == first


def test_written_entry_events_go_when_qualified(cdm, monkeypatch):
    written = []

    def materialize(df, label="stage"):
        written.append((label, session.materialize(df, label)))
        return written[-1][1]

    monkeypatch.setattr(K, "materialize", materialize)
    masked = K.masked_events(cdm, K.drug_family([(P.DRUGS["losartan"], "x")]))
    assert {label: session.path_exists(cdm.spark, f._vitalspan_path) for label, f in written} == {"entries": False, "qualified": True}
    assert masked.count() > 0
