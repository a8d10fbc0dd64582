"""Covariates from domain tables: flags, groups, counts, measurements.

Every build starts from day-level distinct records, so repeated records of one
person on one day cost nothing after the first aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.predicates import filter_concepts, range_group
from vitalspan.operators.ranges import band_join, overlap_join
from vitalspan.operators.summaries import continuous_summary, nonmissing_summary
from vitalspan.operators.vocab import condition_groups, drug_groups, expand_descendants
from vitalspan.plans import params as P
from vitalspan.session import literal_frame, materialize

# table -> (concept column, start column, end column)
DOMAINS = {
    "condition_occurrence": ("condition_concept_id", "condition_start_date", "condition_start_date"),
    "condition_era": ("condition_concept_id", "condition_era_start_date", "condition_era_end_date"),
    "drug_exposure": ("drug_concept_id", "drug_exposure_start_date", "drug_exposure_start_date"),
    "drug_era": ("drug_concept_id", "drug_era_start_date", "drug_era_end_date"),
    "procedure_occurrence": ("procedure_concept_id", "procedure_date", "procedure_date"),
    "device_exposure": ("device_concept_id", "device_exposure_start_date", "device_exposure_start_date"),
    "measurement": ("measurement_concept_id", "measurement_date", "measurement_date"),
    "observation": ("observation_concept_id", "observation_date", "observation_date"),
    "visit_occurrence": ("visit_concept_id", "visit_start_date", "visit_end_date"),
}
ROW = ["cohort_definition_id", "row_id"]


@dataclass(frozen=True)
class DomainAnalysis:
    """One analysis. ``start_day=None`` means any time before ``end_day``."""

    domain: str
    analysis_id: int
    start_day: int | None = -365
    end_day: int = 0
    inpatient: bool = False
    groups: bool = False
    include: tuple[int, ...] = ()
    exclude: tuple[int, ...] = ()
    covariate_ids: tuple[int, ...] = ()
    name: str = ""
    #: Concepts to leave out as a table (``concept_id``), however many.
    without: DataFrame | None = None


def inpatient_visits(cdm) -> DataFrame:
    kinds = cdm.concept_ancestor.filter(F.col("ancestor_concept_id").isin(list(P.INPATIENT_VISITS))).select(
        F.col("descendant_concept_id").alias("visit_concept_id")).distinct()
    return cdm.visit_occurrence.join(kinds, "visit_concept_id", "left_semi").select(
        "person_id", "visit_start_date", "visit_end_date").distinct()


def group_pairs(cdm, domain: str) -> DataFrame:
    if domain.startswith("drug"):
        return drug_groups(cdm.concept, cdm.concept_ancestor, domain == "drug_era")
    return condition_groups(cdm.concept, cdm.concept_ancestor)


def _with_groups(cdm, found: DataFrame, domain: str, rows: list[str]) -> DataFrame:
    """``found`` with a row for each group of its concept, dealt by ``rows``.

    It is written first, so that only pairs of its own concepts take part. Those
    of a domain with few concepts (ingredients) are a small table that is sent
    to all tasks; shuffled by concept, each concept would be one task.
    """
    found = materialize(found, "concepts")
    own = found.select(F.col("concept_id").alias("descendant_concept_id")).distinct()
    pairs = materialize(group_pairs(cdm, domain).join(own, "descendant_concept_id", "left_semi"), "groups")
    return found.repartition(*rows).join(pairs, F.col("concept_id") == F.col("descendant_concept_id"))


def domain_records(cdm, analysis: DomainAnalysis, counted: bool = False) -> DataFrame:
    """Distinct (person, concept, start, end), optionally with a row count ``n``."""
    concept, start, end = DOMAINS[analysis.domain]
    source = getattr(cdm, analysis.domain).filter(F.col(concept) != 0)
    if analysis.exclude:
        source = filter_concepts(source, concept, analysis.exclude, keep=False)
    if analysis.without is not None:
        source = source.join(analysis.without.select(F.col("concept_id").alias(concept)), concept, "left_anti")
    if analysis.include:
        source = filter_concepts(source, concept, analysis.include)
    records = source.groupBy(
        "person_id", F.col(concept).alias("concept_id"), F.col(start).alias("start_date"), F.col(end).alias("end_date"),
    ).agg(F.count(F.lit(1)).alias("n"))
    if analysis.inpatient:
        visits = inpatient_visits(cdm)
        inside = overlap_join(
            records.withColumn("_day", F.col("start_date")), visits, ["person_id"], "start_date", "_day",
            "visit_start_date", "visit_end_date", width=31)
        records = inside.groupBy("person_id", "concept_id", "start_date", "end_date").agg(F.first("n").alias("n"))
    if analysis.groups:
        records = _with_groups(cdm, records, analysis.domain, ["person_id", "start_date", "end_date"]).groupBy(
            "person_id", F.col("ancestor_concept_id").alias("concept_id"), "start_date", "end_date",
        ).agg(F.sum("n").alias("n"))
    return records if counted else records.drop("n")


def _is_point(domain: str) -> bool:
    return DOMAINS[domain][1] == DOMAINS[domain][2]


def in_window(cohort: DataFrame, records: DataFrame, point: bool, start_day: int, end_day: int) -> DataFrame:
    """Cohort rows joined to the records that touch the window."""
    left = cohort.withColumnRenamed("subject_id", "person_id").withColumn(
        "_lo", F.date_add("cohort_start_date", start_day)).withColumn("_hi", F.date_add("cohort_start_date", end_day))
    span = end_day - start_day
    if point:
        return band_join(left, records, ["person_id"], "_lo", "_hi", "start_date", span)
    return overlap_join(left, records, ["person_id"], "_lo", "_hi", "start_date", "end_date", span + 1)


def _row_concepts(cdm, cohort: DataFrame, analyses: Sequence[DomainAnalysis]) -> DataFrame:
    """(row, concept, analysis) of analyses that differ only in id and window.

    The domain is read once and joined over the widest window; each hit is
    then given to the windows it touches. Groups roll up last, from distinct
    concepts of a row, so the history is never multiplied by its ancestors.
    """
    one = analyses[0]
    records = domain_records(cdm, replace(one, groups=False))
    rows = cohort.select(*ROW, "subject_id", "cohort_start_date")
    ever = [a for a in analyses if a.start_day is None]
    windows = [a for a in analyses if a.start_day is not None]
    found = []
    if ever:
        seen = records.groupBy("person_id", "concept_id").agg(F.min("start_date").alias("_first"))
        hit = rows.withColumnRenamed("subject_id", "person_id").join(seen, "person_id")
        ids = [F.when(F.col("_first") <= F.date_add("cohort_start_date", a.end_day), F.lit(a.analysis_id)) for a in ever]
        found.append(hit.select(*ROW, "concept_id", F.explode(F.array_compact(F.array(*ids))).alias("analysis_id")))
    if windows:
        lo, hi = min(a.start_day for a in windows), max(a.end_day for a in windows)
        hit = in_window(rows, records, _is_point(one.domain), lo, hi)
        ids = [F.when((F.col("start_date") <= F.date_add("cohort_start_date", a.end_day))
                      & (F.col("end_date") >= F.date_add("cohort_start_date", a.start_day)), F.lit(a.analysis_id)) for a in windows]
        found.append(hit.select(*ROW, "concept_id", F.explode(F.array_compact(F.array(*ids))).alias("analysis_id")).distinct())
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    if one.groups:
        out = _with_groups(cdm, out, one.domain, ROW).select(
            *ROW, F.col("ancestor_concept_id").alias("concept_id"), "analysis_id").distinct()
    return out


def _ids(frame: DataFrame, analysis: DomainAnalysis) -> DataFrame:
    out = frame.withColumn("covariate_id", F.col("concept_id") * 1000 + analysis.analysis_id).drop("concept_id")
    if analysis.covariate_ids:
        out = filter_concepts(out, "covariate_id", analysis.covariate_ids)
    return out


def domain_flags(cdm, cohort: DataFrame, analysis: DomainAnalysis) -> DataFrame:
    """Binary covariates: the person has the concept in the window."""
    found = _row_concepts(cdm, cohort, [analysis]).drop("analysis_id")
    return _ids(found, analysis).withColumn("covariate_value", F.lit(1.0))


def domain_flags_of(cdm, cohort: DataFrame, analyses: Sequence[DomainAnalysis]) -> list[tuple[list[DomainAnalysis], DataFrame]]:
    """Flags of many analyses: those that differ only in id and window come
    from one read of their domain."""
    alike: dict[DomainAnalysis, list[DomainAnalysis]] = {}
    for a in analyses:
        alike.setdefault(replace(a, analysis_id=0, start_day=0, end_day=0, name=""), []).append(a)
    out = []
    for members in alike.values():
        found = _row_concepts(cdm, cohort, members)
        flags = found.withColumn("covariate_id", F.col("concept_id") * 1000 + F.col("analysis_id")).drop("concept_id", "analysis_id")
        if members[0].covariate_ids:
            flags = filter_concepts(flags, "covariate_id", members[0].covariate_ids)
        out.append((members, flags.withColumn("covariate_value", F.lit(1.0))))
    return out


def population_sizes(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("cohort_definition_id").agg(F.count(F.lit(1)).alias("population_size"))


def aggregate_flags(flags: DataFrame, cohort: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Rows with the covariate per cohort, and their share of the cohort."""
    counts = flags.groupBy("cohort_definition_id", "covariate_id", *extra).agg(F.count(F.lit(1)).alias("sum_value"))
    return counts.join(population_sizes(cohort), "cohort_definition_id").withColumn(
        "average_value", F.col("sum_value") / F.col("population_size")).drop("population_size")


def temporal_flags(cdm, cohort: DataFrame, analysis: DomainAnalysis, windows: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Flags per (time_id, start_day, end_day) window.

    One join covers the whole span; each match then lists the windows it falls
    into, so there is no join against the windows themselves.
    """
    records = domain_records(cdm, analysis)
    lo, hi = min(w[1] for w in windows), max(w[2] for w in windows)
    rows = cohort.select(*ROW, "subject_id", "cohort_start_date")
    hit = in_window(rows, records, _is_point(analysis.domain), lo, hi).select(
        *ROW, "concept_id", F.datediff("start_date", "cohort_start_date").alias("_from"),
        F.datediff("end_date", "cohort_start_date").alias("_to")).distinct()
    table = F.array(*[
        F.struct(F.lit(t).alias("time_id"), F.lit(a).alias("a"), F.lit(b).alias("b")) for t, a, b in windows])
    touched = F.filter(table, lambda w: (w["a"] <= F.col("_to")) & (w["b"] >= F.col("_from")))
    out = hit.select(*ROW, "concept_id", F.explode(touched).alias("w")).select(
        *ROW, "concept_id", F.col("w.time_id").alias("time_id")).distinct()
    return _ids(out, analysis).withColumn("covariate_value", F.lit(1.0))


def part_difference(part: str, start, end):
    """Boundaries of ``part`` crossed from start to end."""
    if part == "day":
        return F.datediff(end, start)
    months = (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))
    return months if part == "month" else F.year(end) - F.year(start)


def sequence_flags(cdm, cohort: DataFrame, analysis: DomainAnalysis, part: str = "day", interval: int = 30) -> DataFrame:
    """Flags per time step counted back from the index date."""
    records = domain_records(cdm, analysis)
    rows = cohort.select(*ROW, "subject_id", "cohort_start_date")
    hit = in_window(rows, records.withColumn("end_date", F.col("start_date")), True, analysis.start_day, analysis.end_day)
    step = F.floor(part_difference(part, F.col("start_date"), F.col("cohort_start_date")) / F.lit(interval))
    out = hit.select(*ROW, "concept_id", step.alias("time_id")).distinct()
    return _ids(out, analysis).withColumn("covariate_value", F.lit(1.0))


def concept_counts(cdm, cohort: DataFrame, analysis: DomainAnalysis, kind: str = "total") -> DataFrame:
    """Records in the window per row: ``total``, ``distinct`` concepts or
    ``stratified`` by concept. Rows without records are omitted."""
    rows = cohort.select(*ROW, "subject_id", "cohort_start_date")
    records = domain_records(cdm, analysis, counted=True)
    if kind == "total":
        records = records.groupBy("person_id", "start_date", "end_date").agg(F.sum("n").alias("n"))
    hit = in_window(rows, records, _is_point(analysis.domain), analysis.start_day, analysis.end_day)
    scalar = F.lit(1000 + analysis.analysis_id).cast("long")
    if kind == "stratified":
        out = hit.groupBy(*ROW, "concept_id").agg(F.sum("n").cast("double").alias("covariate_value"))
        return _ids(out, analysis)
    value = F.countDistinct("concept_id") if kind == "distinct" else F.sum("n")
    return hit.groupBy(*ROW).agg(value.cast("double").alias("covariate_value")).withColumn("covariate_id", scalar)


def aggregate_counts(counts: DataFrame, cohort: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Zero-filled distribution per cohort and covariate."""
    return continuous_summary(
        counts, population_sizes(cohort), ["cohort_definition_id", "covariate_id", *extra], ["cohort_definition_id"],
        "covariate_value")


def measurement_covariate_id(analysis_id: int | Column):
    unit = F.col("unit_concept_id") % 1000
    return (F.col("measurement_concept_id") * 1000000 + unit * 1000 + analysis_id).cast("long")


def _daily_values(cdm, analysis: DomainAnalysis) -> DataFrame:
    """The lowest value of each person, measurement, unit and day."""
    m = cdm.measurement.filter(
        F.col("value_as_number").isNotNull() & F.col("unit_concept_id").isNotNull() & (F.col("measurement_concept_id") != 0))
    if analysis.exclude:
        m = filter_concepts(m, "measurement_concept_id", analysis.exclude, keep=False)
    if analysis.include:
        m = filter_concepts(m, "measurement_concept_id", analysis.include)
    return m.groupBy(
        "person_id", "measurement_concept_id", "unit_concept_id", F.col("measurement_date").alias("start_date")
    ).agg(F.min("value_as_number").alias("value_as_number"))


def measurement_values(
    cdm, cohort: DataFrame, analysis: DomainAnalysis, windows: Sequence[tuple[int, int, int]] | None = None,
) -> DataFrame:
    """Latest value per measurement; ties on the day go to the lowest unit,
    then the lowest value. ``windows`` gives one value per time window."""
    if not windows:
        return measurement_values_of(cdm, cohort, [analysis]).drop("analysis_id")
    daily = _daily_values(cdm, analysis)
    rows = cohort.select(*ROW, "subject_id", "cohort_start_date")
    keys = [*ROW, "measurement_concept_id", "time_id"]
    lo, hi = min(w[1] for w in windows), max(w[2] for w in windows)
    table = F.array(*[
        F.struct(F.lit(t).alias("time_id"), F.lit(a).alias("a"), F.lit(b).alias("b")) for t, a, b in windows])
    offset = F.datediff("start_date", "cohort_start_date")
    hit = in_window(rows, daily, True, lo, hi).withColumn(
        "w", F.explode(F.filter(table, lambda w: (w["a"] <= offset) & (w["b"] >= offset))))
    hit = hit.withColumn("time_id", F.col("w.time_id"))
    latest = F.max(F.struct("start_date", (-F.col("unit_concept_id")).alias("u"), F.col("value_as_number").alias("v")))
    flat = hit.groupBy(*keys).agg(latest.alias("best")).select(
        *keys, (-F.col("best.u")).alias("unit_concept_id"), F.col("best.v").alias("covariate_value")
    ).withColumn("covariate_id", measurement_covariate_id(analysis.analysis_id))
    out = flat.select(*ROW, "covariate_id", "time_id", "covariate_value")
    return filter_concepts(out, "covariate_id", analysis.covariate_ids) if analysis.covariate_ids else out


def measurement_values_of(cdm, cohort: DataFrame, analyses: Sequence[DomainAnalysis]) -> DataFrame:
    """Latest values of analyses that differ only in id and window, with
    ``analysis_id``.

    Values of the days are written, then dealt by person and listed by person
    and measurement, at most one for each unit and day. A row meets the lists of
    its person and takes from each the last value up to the end of a window, if
    the window reaches back to it: no (row, value) pairs are formed, and windows
    of any length share one join. Row ids that repeat have one value in all.
    """
    one = analyses[0]
    daily = materialize(_daily_values(cdm, one), "daily").filter(F.col("start_date").isNotNull())
    value = F.struct("start_date", (-F.col("unit_concept_id")).alias("u"), F.col("value_as_number").alias("v"))
    lists = daily.repartition("person_id").groupBy("person_id", "measurement_concept_id").agg(
        F.sort_array(F.collect_list(value)).alias("_days"))
    who = F.struct(F.col("subject_id").alias("person_id"), "cohort_start_date")
    rows = materialize(cohort.groupBy(*ROW).agg(F.collect_set(who).alias("_who")), "rows")

    def latest(a: DomainAnalysis) -> Column:
        end = F.date_add("cohort_start_date", a.end_day)
        last = F.try_element_at(F.filter("_days", lambda d: d["start_date"] <= end), F.lit(-1))
        reached = last["start_date"] >= F.date_add("cohort_start_date", a.start_day) if a.start_day is not None else last.isNotNull()
        return F.when(reached, F.struct(F.lit(a.analysis_id).alias("analysis_id"), last.alias("best")))

    found = rows.select(*ROW, F.inline("_who")).join(lists, "person_id").select(
        *ROW, "measurement_concept_id", F.inline(F.array_compact(F.array(*[latest(a) for a in analyses]))))
    if not rows.filter(F.size("_who") > 1).isEmpty():
        found = found.groupBy(*ROW, "measurement_concept_id", "analysis_id").agg(F.max("best").alias("best"))
    out = found.withColumn("unit_concept_id", -F.col("best.u")).select(
        *ROW, measurement_covariate_id(F.col("analysis_id")).alias("covariate_id"), F.col("best.v").alias("covariate_value"), "analysis_id")
    return filter_concepts(out, "covariate_id", one.covariate_ids) if one.covariate_ids else out


def aggregate_measurements(values: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return nonmissing_summary(values, ["cohort_definition_id", "covariate_id", *extra], "covariate_value")


def measurement_ranges(cdm, cohort: DataFrame, analysis: DomainAnalysis) -> DataFrame:
    """Below (1), within (2) or above (3) the normal range in the window."""
    m = cdm.measurement.filter(
        F.col("range_low").isNotNull() & F.col("range_high").isNotNull() & (F.col("measurement_concept_id") != 0))
    if analysis.exclude:
        m = filter_concepts(m, "measurement_concept_id", analysis.exclude, keep=False)
    if analysis.include:
        m = filter_concepts(m, "measurement_concept_id", analysis.include)
    records = m.select(
        "person_id", F.col("measurement_concept_id").alias("concept_id"), F.col("measurement_date").alias("start_date"),
        range_group("value_as_number", "range_low", "range_high").alias("grp")).distinct()
    rows = cohort.select(*ROW, "subject_id", "cohort_start_date")
    if analysis.start_day is None:
        seen = records.groupBy("person_id", "concept_id", "grp").agg(F.min("start_date").alias("_first"))
        hit = rows.withColumnRenamed("subject_id", "person_id").join(seen, "person_id").filter(
            F.col("_first") <= F.date_add("cohort_start_date", analysis.end_day))
    else:
        hit = in_window(rows, records, True, analysis.start_day, analysis.end_day)
    covariate = F.col("concept_id") * 10000 + F.col("grp") * 1000 + analysis.analysis_id
    return hit.select(*ROW, covariate.alias("covariate_id")).distinct().withColumn("covariate_value", F.lit(1.0))


def exclude_with_descendants(cdm, analysis: DomainAnalysis, ids: Sequence[int]) -> DomainAnalysis:
    """The same analysis without the ids and all their descendants, which
    stay a table and are joined."""
    gone = expand_descendants(cdm.concept_ancestor, ids)
    if analysis.without is not None:
        gone = gone.unionByName(analysis.without.select("concept_id")).distinct()
    return replace(analysis, without=gone)


def covariate_reference(covariates: DataFrame, concept: DataFrame, analysis: DomainAnalysis) -> DataFrame:
    """Names and concepts of the covariates; unknown concepts are labelled."""
    concept_id = F.floor((F.col("covariate_id") - analysis.analysis_id) / 1000)
    ids = covariates.select("covariate_id").distinct().withColumn("concept_id", concept_id)
    window = (
        f" any time prior through {analysis.end_day} days relative to index: " if analysis.start_day is None
        else f" during day {analysis.start_day} through {analysis.end_day} days relative to index: ")
    names = concept.select("concept_id", "concept_name")
    label = F.concat(
        F.lit(analysis.domain + window), F.coalesce("concept_name", F.lit("Unknown concept")),
        F.lit(" (inpatient)" if analysis.inpatient else ""))
    return ids.join(names, "concept_id", "left").select(
        "covariate_id", label.alias("covariate_name"), F.lit(analysis.analysis_id).alias("analysis_id"), "concept_id")


def analysis_reference(spark, analyses: Sequence[tuple]) -> DataFrame:
    """(analysis_id, name, domain, start_day, end_day, is_binary, missing_means_zero)."""
    return literal_frame(
        spark, list(analyses),
        "analysis_id long, analysis_name string, domain_id string, start_day int, end_day int, is_binary string, "
        "missing_means_zero string")
