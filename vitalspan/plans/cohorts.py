"""Cohort engine: entry events, inclusion rules, exit, collapse, statistics.

Definitions are data. Definitions that differ only in their id and entry
concepts run as one family: one scan and one set of joins for all of them.
Events that coincide in cohort, person and dates are one row with a count, so
nothing depends on how often a record repeats.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.dates import age_by_year
from vitalspan.functions.predicates import any_of, compare, ratio_to_limit
from vitalspan.operators.intervals import collapse_intervals
from vitalspan.operators.ranges import period_of, window_counts
from vitalspan.operators.ranks import first_per_key
from vitalspan.plans import params as P
from vitalspan.session import discard, literal_frame, materialize

EVENT = ["cohort_definition_id", "person_id", "start_date", "end_date", "op_start_date", "op_end_date"]


# --- definitions ---------------------------------------------------------------
@dataclass(frozen=True)
class LabTest:
    """Measurements of some concepts, optionally beyond a threshold given as
    a multiple of the upper limit (``ratio``) or an absolute ``value``."""

    concepts: tuple[int, ...]
    ratio: tuple[str, float] | None = None
    value: tuple[str, float] | None = None

    def matches(self) -> Column:
        test = F.col("measurement_concept_id").isin(list(self.concepts))
        if self.ratio:
            test = test & compare(ratio_to_limit("value_as_number", "range_high"), *self.ratio)
        if self.value:
            test = test & compare(F.col("value_as_number"), *self.value)
        return F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class DrugEntry:
    concepts: tuple[int, ...]


@dataclass(frozen=True)
class LabEntry:
    """Any of the tests; ``paired`` tests also need a companion test within
    some days: (test, companion, days)."""

    tests: tuple[LabTest, ...]
    paired: tuple[tuple[LabTest, LabTest, int], ...] = ()


@dataclass(frozen=True)
class DeathEntry:
    pass


@dataclass(frozen=True)
class Criterion:
    test: LabTest
    op: str = ">="
    n: int = 1


@dataclass(frozen=True)
class LabRule:
    """A group of criteria counted in a window around the event start."""

    criteria: tuple[Criterion, ...]
    mode: str = "all"  # all | any | at_least
    at_least: int = 1
    lo: int = -60
    hi: int = 0

    def needed(self) -> int:
        return {"all": len(self.criteria), "any": 1, "at_least": self.at_least}[self.mode]

    def label(self) -> str:
        return f"at least {self.needed()} of {len(self.criteria)} lab criteria from day {self.lo} to {self.hi}"


@dataclass(frozen=True)
class PersonRule:
    older_than: int | None = None
    genders: tuple[int, ...] = ()

    def label(self) -> str:
        age = "any age" if self.older_than is None else f"older than {self.older_than}"
        return age + (f", gender {', '.join(map(str, self.genders))}" if self.genders else "")


@dataclass(frozen=True)
class CohortDefinition:
    cohort_definition_id: int
    name: str
    entry: DrugEntry | LabEntry | DeathEntry
    prior_days: int = 0
    post_days: int = 0
    first_only: bool = False  # first entry event, before period and rules
    included_first_only: bool = False  # first event that passes the rules
    rules: tuple[LabRule | PersonRule, ...] = ()
    exit_days: int | None = 7  # None: end of observation
    gap_days: int = 0

    def checksum(self) -> str:
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def template(self) -> "CohortDefinition":
        entry = DrugEntry(()) if isinstance(self.entry, DrugEntry) else self.entry
        return replace(self, cohort_definition_id=0, name="", entry=entry)


# --- entry events -----------------------------------------------------------------
def drug_events(cdm, definitions: Sequence[CohortDefinition]) -> DataFrame:
    """Drug eras of every definition's concepts in one pass."""
    pairs = [(d.cohort_definition_id, c) for d in definitions for c in d.entry.concepts]
    wanted = literal_frame(cdm.spark, pairs, "cohort_definition_id long, drug_concept_id long")
    return cdm.drug_era.join(wanted, "drug_concept_id").select(
        "cohort_definition_id", "person_id", F.col("drug_era_start_date").alias("start_date"),
        F.col("drug_era_end_date").alias("end_date"))


def lab_days(cdm, test: LabTest) -> DataFrame:
    """Days on which a person has a matching measurement, with the count."""
    return cdm.measurement.filter(test.matches()).groupBy(
        "person_id", F.col("measurement_date").alias("start_date")).agg(F.count(F.lit(1)).alias("n"))


def nearby_days(cdm, test: LabTest, companion: LabTest, days: int) -> DataFrame:
    """Matching days that have a companion measurement within ``days``, both
    inside one observation period."""
    base = period_of(lab_days(cdm, test), cdm.observation_period, "start_date")
    counted = window_counts(
        base, cdm.measurement, ["person_id"], "start_date", "measurement_date", -days, days,
        {"near": companion.matches()}, ("op_start_date", "op_end_date"))
    return counted.filter(F.col("near") > 0).select("person_id", "start_date", "n")


def lab_events(cdm, definition: CohortDefinition) -> DataFrame:
    entry = definition.entry
    single = cdm.measurement.filter(any_of([t.matches() for t in entry.tests]) if entry.tests else F.lit(False))
    parts = [single.groupBy("person_id", F.col("measurement_date").alias("start_date")).agg(F.count(F.lit(1)).alias("n"))]
    parts += [nearby_days(cdm, *p) for p in entry.paired]
    both = reduce(DataFrame.unionByName, parts)
    days = both.groupBy("person_id", "start_date").agg(F.sum("n").alias("n"))
    return days.select(
        F.lit(definition.cohort_definition_id).cast("long").alias("cohort_definition_id"), "person_id", "start_date",
        F.date_add("start_date", 1).alias("end_date"), "n")


def death_events(cdm, definition: CohortDefinition) -> DataFrame:
    return cdm.death.select(
        F.lit(definition.cohort_definition_id).cast("long").alias("cohort_definition_id"), "person_id",
        F.col("death_date").alias("start_date"), F.date_add("death_date", 1).alias("end_date"))


def entry_events(cdm, definitions: Sequence[CohortDefinition]) -> DataFrame:
    entry = definitions[0].entry
    if isinstance(entry, DrugEntry):
        events = drug_events(cdm, definitions)
    else:
        build = lab_events if isinstance(entry, LabEntry) else death_events
        events = reduce(DataFrame.unionByName, [build(cdm, d) for d in definitions])
    if "n" not in events.columns:
        events = events.withColumn("n", F.lit(1).cast("long"))
    if definitions[0].first_only:
        events = first_per_key(events, ["cohort_definition_id", "person_id"], ["start_date", "end_date"]).withColumn(
            "n", F.lit(1).cast("long"))
    return events


def one_event_per_day(definitions: Sequence[CohortDefinition]) -> bool:
    """Whether entry events are unique per cohort, person and start by
    construction: days of lab results, deaths, first events, or eras of a
    single ingredient."""
    entry = definitions[0].entry
    return (
        not isinstance(entry, DrugEntry) or definitions[0].first_only
        or all(len(set(d.entry.concepts)) == 1 for d in definitions))


def qualified_events(cdm, definitions: Sequence[CohortDefinition], entries: DataFrame | None = None) -> DataFrame:
    """Entry events inside an observation period with enough days on both sides."""
    d = definitions[0]
    entries = entry_events(cdm, definitions) if entries is None else entries
    events = period_of(entries, cdm.observation_period, "start_date")
    enough = (F.date_add("op_start_date", d.prior_days) <= F.col("start_date")) & (
        F.date_add("start_date", d.post_days) <= F.col("op_end_date"))
    kept = events.filter(enough)
    if one_event_per_day(definitions):
        return kept.select(*EVENT, "n")
    return kept.groupBy(*EVENT).agg(F.sum("n").alias("n"))


# --- inclusion rules --------------------------------------------------------------
def rule_flags(cdm, events: DataFrame, rules: Sequence[LabRule | PersonRule]) -> DataFrame:
    """Add a boolean ``rule_<i>`` per rule.

    All lab rules with the same window share one join against day-level counts.
    """
    out = events
    by_window: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, r in enumerate(rules):
        if isinstance(r, LabRule):
            by_window[(r.lo, r.hi)].append(i)
    counted: list[str] = []
    for (lo, hi), members in by_window.items():
        criteria = {f"_c{i}_{j}": c.test.matches() for i in members for j, c in enumerate(rules[i].criteria)}
        concepts = sorted({x for i in members for c in rules[i].criteria for x in c.test.concepts})
        records = cdm.measurement.filter(F.col("measurement_concept_id").isin(concepts))
        out = window_counts(
            out, records, ["person_id"], "start_date", "measurement_date", lo, hi, criteria,
            ("op_start_date", "op_end_date"))
        counted += list(criteria)
    if any(isinstance(r, PersonRule) for r in rules):
        people = cdm.person.select("person_id", "year_of_birth", "gender_concept_id")
        out = out.join(people, "person_id", "left")
    flags = []
    for i, r in enumerate(rules):
        if isinstance(r, LabRule):
            met = [compare(F.col(f"_c{i}_{j}"), c.op, c.n).cast("int") for j, c in enumerate(r.criteria)]
            test = reduce(lambda a, b: a + b, met) >= r.needed()
        else:
            test = F.lit(True)
            if r.older_than is not None:
                test = test & (age_by_year("start_date", "year_of_birth") > r.older_than)
            if r.genders:
                test = test & F.col("gender_concept_id").isin(list(r.genders))
        flags.append(F.coalesce(test, F.lit(False)).alias(f"rule_{i}"))
    return out.select(*events.columns, *flags)


def inclusion_mask(flagged: DataFrame, n_rules: int) -> DataFrame:
    """One bit per satisfied rule."""
    bits = [F.when(F.col(f"rule_{i}"), F.lit(1 << i)).otherwise(0) for i in range(n_rules)]
    mask = reduce(lambda a, b: a + b, bits, F.lit(0)).cast("long")
    return flagged.withColumn("inclusion_rule_mask", mask)


def masked_events(cdm, definitions: Sequence[CohortDefinition]) -> DataFrame:
    """Qualified events with their rule mask. With lab rules entry events and
    qualified ones are written, so that the shuffles behind them are gone when
    the measurements are shuffled."""
    rules = definitions[0].rules
    if any(isinstance(r, LabRule) for r in rules):
        entries = materialize(entry_events(cdm, definitions), "entries")
        events = materialize(qualified_events(cdm, definitions, entries), "qualified")
        discard(entries)
    else:
        events = qualified_events(cdm, definitions)
    return inclusion_mask(rule_flags(cdm, events, rules), len(rules))


def included(masked: DataFrame, definition: CohortDefinition) -> DataFrame:
    full = (1 << len(definition.rules)) - 1
    kept = masked.filter(F.col("inclusion_rule_mask") == full)
    if definition.included_first_only:
        kept = first_per_key(
            kept.select(*EVENT), ["cohort_definition_id", "person_id"], ["start_date", "end_date"])
    return kept.select(*EVENT)


# --- exit and collapse --------------------------------------------------------------
def exit_fixed_offset(events: DataFrame, days: int) -> DataFrame:
    return events.withColumn("exit_date", F.least(F.date_add("start_date", days), F.col("op_end_date")))


def exit_observation_end(events: DataFrame) -> DataFrame:
    return events.withColumn("exit_date", F.col("op_end_date"))


def final_cohort(events: DataFrame, definition: CohortDefinition, unique_days: bool = False) -> DataFrame:
    """One valid exit per event, then merge overlapping stays."""
    ends = (
        exit_observation_end(events) if definition.exit_days is None
        else exit_fixed_offset(events, definition.exit_days))
    merged = collapse_intervals(
        ends, ["cohort_definition_id", "person_id"], "start_date", "exit_date", definition.gap_days,
        unique_starts=unique_days)
    return merged.select(
        "cohort_definition_id", F.col("person_id").alias("subject_id"), F.col("start_date").alias("cohort_start_date"),
        F.col("exit_date").alias("cohort_end_date"))


def families(definitions: Iterable[CohortDefinition]) -> list[list[CohortDefinition]]:
    groups: dict[CohortDefinition, list[CohortDefinition]] = defaultdict(list)
    for d in definitions:
        groups[d.template()].append(d)
    return list(groups.values())


def build_family(cdm, family: Sequence[CohortDefinition]) -> DataFrame:
    events = included(masked_events(cdm, family), family[0])
    return final_cohort(events, family[0], one_event_per_day(family))


def unique_definitions(definitions: Iterable[CohortDefinition]) -> list[CohortDefinition]:
    """The first definition of each (id, name)."""
    seen: dict[tuple[int, str], CohortDefinition] = {}
    for d in definitions:
        seen.setdefault((d.cohort_definition_id, d.name), d)
    return list(seen.values())


def build_cohorts(cdm, definitions: Iterable[CohortDefinition]) -> DataFrame:
    """All cohorts; definitions sharing a template are built together.

    Families are independent, so their written stages run side by side.
    """
    groups = families(definitions)
    with ThreadPoolExecutor(max_workers=min(4, len(groups))) as pool:
        built = list(pool.map(lambda f: build_family(cdm, f), groups))
    return reduce(DataFrame.unionByName, built)


# --- statistics ---------------------------------------------------------------------
def best_events(masked: DataFrame) -> DataFrame:
    """Per person the event that satisfies most rules; ties go to the earliest
    rule met, then the earliest start."""
    met = F.bit_count("inclusion_rule_mask")
    lowest = F.when(F.col("inclusion_rule_mask") == 0, F.lit(0)).otherwise(
        F.log2((F.col("inclusion_rule_mask").bitwiseAND(-F.col("inclusion_rule_mask"))).cast("double")).cast("int"))
    picked = first_per_key(
        masked.select(*EVENT, "inclusion_rule_mask"), ["cohort_definition_id", "person_id"],
        [-met, lowest, "start_date", "end_date"])
    return picked.withColumn("n", F.lit(1).cast("long"))


def inclusion_result(masked: DataFrame) -> DataFrame:
    """Events per mask: mode 0 counts all events, mode 1 the best per person."""
    def counted(frame, mode):
        return frame.groupBy("cohort_definition_id", "inclusion_rule_mask").agg(
            F.sum("n").alias("person_count")).withColumn("mode_id", F.lit(mode))

    return counted(masked, 0).unionByName(counted(best_events(masked), 1))


def cohort_stats(masked: DataFrame, n_rules: int) -> dict[str, DataFrame]:
    """The three statistics tables; masks and their counts are written once."""
    result = materialize(inclusion_result(materialize(masked, "masked")), "inclusion-result")
    return {
        "inclusion_result": result, "inclusion_stats": inclusion_stats(result, n_rules),
        "summary_stats": summary_stats(result, n_rules),
    }


def inclusion_rules(spark, definitions: Sequence[CohortDefinition]) -> DataFrame:
    """Names of the inclusion rules by definition and place in its list."""
    rows = [(d.cohort_definition_id, i, r.label()) for d in definitions for i, r in enumerate(d.rules)]
    return literal_frame(spark, rows, "cohort_definition_id long, rule_sequence int, name string")


def inclusion_stats(result: DataFrame, n_rules: int) -> DataFrame:
    """Per rule: events meeting it, events failing only it, and the total."""
    full = (1 << n_rules) - 1
    mask, n = F.col("inclusion_rule_mask"), F.col("person_count")
    rules = F.array(*[
        F.struct(
            F.lit(i).alias("rule_sequence"),
            F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, n).otherwise(0).alias("met"),
            F.when(mask == full - (1 << i), n).otherwise(0).alias("gain"))
        for i in range(n_rules)])
    return result.select("cohort_definition_id", "mode_id", n, F.explode(rules).alias("r")).groupBy(
        "cohort_definition_id", "mode_id", F.col("r.rule_sequence").alias("rule_sequence")
    ).agg(F.sum("r.met").alias("person_count"), F.sum("r.gain").alias("gain_count"),
          F.sum("person_count").alias("person_total"))


def summary_stats(result: DataFrame, n_rules: int) -> DataFrame:
    full = (1 << n_rules) - 1
    return result.groupBy("cohort_definition_id", "mode_id").agg(
        F.sum("person_count").alias("base_count"),
        F.sum(F.when(F.col("inclusion_rule_mask") == full, F.col("person_count")).otherwise(0)).alias("final_count"))


def censor_stats(uncensored: DataFrame, censored: DataFrame) -> DataFrame:
    """Cohort rows lost to censoring, per definition."""
    def counted(df, name):
        return df.groupBy("cohort_definition_id").agg(F.count(F.lit(1)).alias(name))

    both = counted(uncensored, "_before").join(counted(censored, "_after"), "cohort_definition_id", "left")
    return both.select(
        "cohort_definition_id", (F.col("_before") - F.coalesce(F.col("_after"), F.lit(0))).alias("lost_count"))


def censor_at(cohort: DataFrame, events: DataFrame, person: str, date: str) -> DataFrame:
    """End each row at the first censoring event; rows that would end before
    they start are lost."""
    first = events.groupBy(F.col(person).alias("subject_id")).agg(F.min(date).alias("_censor"))
    cut = cohort.join(first, "subject_id", "left").withColumn(
        "cohort_end_date", F.least("cohort_end_date", "_censor"))
    return cut.filter(F.col("cohort_end_date") >= F.col("cohort_start_date")).select(*cohort.columns)


def cohort_counts(cohort: DataFrame, ids: Sequence[int] | None = None, database_id: str | None = None) -> DataFrame:
    kept = cohort if ids is None else cohort.filter(F.col("cohort_definition_id").isin(list(ids)))
    out = kept.groupBy("cohort_definition_id").agg(
        F.count(F.lit(1)).alias("cohort_entries"), F.countDistinct("subject_id").alias("cohort_subjects"))
    return out if database_id is None else out.withColumn("database_id", F.lit(database_id))


def named_counts(counts: DataFrame, names: DataFrame) -> DataFrame:
    """Counts with the first name listed per cohort id, name first."""
    first = names.groupBy("cohort_definition_id").agg(F.min(F.struct("seq", "cohort_name")).alias("f"))
    return counts.join(first, "cohort_definition_id", "left").select(
        "cohort_definition_id", F.col("f.cohort_name").alias("cohort_name"), "cohort_entries", "cohort_subjects")


# --- shipped definitions -----------------------------------------------------------
def _measured() -> LabRule:
    return LabRule(tuple(Criterion(LabTest((c,))) for c in P.LIVER_LABS), "at_least", 2)


def _normal() -> LabRule:
    return LabRule(tuple(Criterion(LabTest((c,), ratio=(">", 1.0)), "<=", 0) for c in P.LIVER_LABS), "all")


def liver_target(cid: int, name: str, drug: int, prior_days: int = 30, first_only: bool = False) -> CohortDefinition:
    return CohortDefinition(
        cid, name, DrugEntry((drug,)), prior_days=prior_days, first_only=first_only, rules=(_measured(), _normal()))


def liver_outcome_a(cid: int = 100) -> CohortDefinition:
    paired = (LabTest((P.BILIRUBIN,), ratio=(">", 2.0)), LabTest((P.ALT,), ratio=(">", 3.0)), 7)
    return CohortDefinition(cid, "liver injury A", LabEntry(
        (LabTest((P.ALT,), ratio=(">", 5.0)), LabTest((P.ALP,), ratio=(">", 2.0))), (paired,)))


def liver_outcome_b(cid: int = 101) -> CohortDefinition:
    return CohortDefinition(cid, "liver injury B", LabEntry((
        LabTest((P.AST,), ratio=(">", 3.0)), LabTest((P.ALT,), ratio=(">", 3.0)), LabTest((P.ALP,), ratio=(">", 2.0)),
        LabTest((P.BILIRUBIN,), ratio=(">", 2.0)), LabTest((P.AST,), value=(">", 200.0)),
        LabTest((P.ALT,), value=(">", 200.0)))))


def renal_target(cid: int, name: str, drug: int, strict_reference: bool = True) -> CohortDefinition:
    """``strict_reference`` keeps the comparator as published (below 1.2 is
    disqualifying); otherwise a value above 1.2 is."""
    any_value = LabTest((P.CREATININE,))
    bad = LabTest((P.CREATININE,), value=("<" if strict_reference else ">", 1.2))
    return CohortDefinition(cid, name, DrugEntry((drug,)), prior_days=30, rules=(
        LabRule((Criterion(any_value, ">=", 2),)), LabRule((Criterion(bad, "<=", 0),))))


def renal_outcome(cid: int = 200) -> CohortDefinition:
    return CohortDefinition(
        cid, "kidney injury", LabEntry((LabTest(P.RENAL_MARKERS, value=(">", 1.2)),)), gap_days=30)


def first_drug_cohorts(drug: int, ids: tuple[int, int, int] = (1, 2, 3)) -> list[CohortDefinition]:
    """First era; plus age over 40; plus age over 40 and male. Ends with observation."""
    over_40, male = PersonRule(older_than=40), PersonRule(genders=(P.MALE,))
    shape = dict(entry=DrugEntry((drug,)), first_only=True, exit_days=None)
    return [
        CohortDefinition(ids[0], "celecoxib", **shape),
        CohortDefinition(ids[1], "celecoxibAge40", rules=(over_40,), **shape),
        CohortDefinition(ids[2], "celecoxibAge40Male", rules=(over_40, male), **shape),
    ]


def drug_family(drugs: Iterable[tuple[int, str]], base: int = 1000) -> list[CohortDefinition]:
    """One liver target per drug: a single family, one pass."""
    return [liver_target(base + i, name, concept) for i, (concept, name) in enumerate(drugs)]
