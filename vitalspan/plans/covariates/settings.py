"""Covariate settings: presets to analyses, extraction and aggregation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.operators.summaries import SUMMARY_COLUMNS, continuous_summary, nonmissing_summary
from vitalspan.plans.covariates import demographics as G
from vitalspan.plans.covariates import domain as D
from vitalspan.plans.covariates import scores as S
from vitalspan.sources.store import CovariateData

# First analysis id of each domain; windows add 0 (any time),
# 1 (long), 2 (medium) and 3 (short).
ANALYSIS_BASE = {
    "condition_occurrence": 101, "condition_era": 201, "drug_exposure": 301, "drug_era": 401,
    "procedure_occurrence": 501, "device_exposure": 601, "measurement": 701, "observation": 801,
}
GROUP_BASE = {"condition_era": 209, "drug_era": 409, "drug_exposure": 309}
WINDOWS = ("any_time", "long", "medium", "short")
DEMOGRAPHICS: dict[str, Callable] = {
    "gender": G.gender, "race": G.race, "ethnicity": G.ethnicity, "age": G.age, "age_group": G.age_group,
    "index_year": G.index_year, "index_month": G.index_month, "time_prior": G.time_prior, "time_post": G.time_post,
    "time_in_cohort": G.time_in_cohort,
}
# Analysis id, whether the value is a flag, and whether a missing
# value means zero, of each demographic and score.
PERSON_ANALYSES = {
    "gender": (1, "Y", None), "age": (2, "N", "Y"), "age_group": (3, "Y", None), "race": (4, "Y", None), "ethnicity": (5, "Y", None),
    "index_year": (6, "Y", None), "index_month": (7, "Y", None), "time_prior": (8, "N", "Y"), "time_post": (9, "N", "Y"),
    "time_in_cohort": (10, "N", "Y"),
}
SCORE_ANALYSES = {"charlson": 901, "dcsi": 902, "chads2": 903, "chads2vasc": 904, "hfrs": 926}
SCORES: dict[str, Callable] = {
    "charlson": S.charlson, "chads2": S.chads2, "chads2vasc": S.chads2vasc, "dcsi": S.dcsi, "hfrs": S.hfrs,
}


@dataclass(frozen=True)
class CovariateSettings:
    """Which covariates to build. ``custom`` builders take (cdm, cohort) and
    return covariate rows."""

    demographics: tuple[str, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    measurement_values: bool = False
    scores: tuple[str, ...] = ()
    long_days: int = -365
    medium_days: int = -180
    short_days: int = -30
    end_day: int = 0
    include: tuple[int, ...] = ()
    exclude: tuple[int, ...] = ()
    custom: tuple[Callable, ...] = ()

    def analyses(self) -> list[D.DomainAnalysis]:
        start = {"any_time": None, "long": self.long_days, "medium": self.medium_days, "short": self.short_days}
        out = []
        for table, base, grouped in (
            *[(t, ANALYSIS_BASE[t], False) for t in self.domains], *[(t, GROUP_BASE[t], True) for t in self.groups]
        ):
            for w in (self.groups if grouped else self.domains)[table]:
                out.append(D.DomainAnalysis(
                    table, base + WINDOWS.index(w), start[w], self.end_day, groups=grouped, include=self.include,
                    exclude=self.exclude, name=f"{table} {w}"))
        return out


def extract(cdm, cohort: DataFrame, settings: CovariateSettings) -> CovariateData:
    """All requested covariates in one lazy union, with one reference row per
    analysis and one per covariate.

    A custom builder may name its analyses in an attribute ``analyses`` (rows
    of ``analysis_reference``); without it they are flags named after it.
    """
    parts, refs, names = [], [], []
    for members, flags in D.domain_flags_of(cdm, cohort, settings.analyses()):
        parts.append(flags)
        names += [D.covariate_reference(flags.filter(F.pmod("covariate_id", F.lit(1000)) == a.analysis_id), cdm.concept, a) for a in members]
    for a in settings.analyses():
        refs.append((a.analysis_id, a.name, a.domain, a.start_day, a.end_day, "Y", None))
    for name in settings.demographics:
        parts.append(DEMOGRAPHICS[name](cdm, cohort))
        number, binary, zero = PERSON_ANALYSES[name]
        refs.append((number, name, "Demographics", None, None, binary, zero))
        names.append(_plain_names(parts[-1], name))
    for name in settings.scores:
        parts.append(SCORES[name](cdm, cohort))
        refs.append((SCORE_ANALYSES[name], name, "Condition", None, settings.end_day, "N", "Y"))
        names.append(_plain_names(parts[-1], name))
    for builder in settings.custom:
        parts.append(builder(cdm, cohort))
        label = getattr(builder, "__name__", "custom")
        refs += getattr(builder, "analyses", ())
        names.append(_plain_names(parts[-1], label))
    if settings.measurement_values:
        labs = D.DomainAnalysis(
            "measurement", 705, settings.long_days, settings.end_day, include=settings.include, exclude=settings.exclude)
        parts.append(D.measurement_values(cdm, cohort, labs))
        names.append(_plain_names(parts[-1], "measurement value"))
        refs.append((705, "measurement value", "Measurement", settings.long_days, settings.end_day, "N", "N"))
    out = None
    for p in parts:
        p = p.select(*D.ROW, "covariate_id", F.col("covariate_value").cast("double").alias("covariate_value"))
        out = p if out is None else out.unionByName(p)
    reference = None
    for n in names:
        n = n.select(F.col("covariate_id").cast("long"), "covariate_name", F.col("analysis_id").cast("long"), F.col("concept_id").cast("long"))
        reference = n if reference is None else reference.unionByName(n)
    return CovariateData(out, covariate_ref=reference, analysis_ref=D.analysis_reference(cdm.spark, refs) if refs else None)


def _plain_names(covariates: DataFrame, label: str) -> DataFrame:
    """Reference rows of covariates that carry no concept of their own."""
    ids = covariates.select(F.col("covariate_id").cast("long").alias("covariate_id")).distinct()
    number = F.floor(F.col("covariate_id") / 1000)
    return ids.select("covariate_id", F.concat(F.lit(label + ": "), number.cast("string")).alias("covariate_name"),
                      F.pmod("covariate_id", F.lit(1000)).alias("analysis_id"), F.lit(0).cast("long").alias("concept_id"))


def aggregate(covariates: DataFrame, analysis_ref: DataFrame, cohort: DataFrame) -> DataFrame:
    """Per-person covariates to distributions: zero-filled, over non-missing
    values, or plain shares, as each analysis declares. A covariate of an
    undeclared analysis stops the run instead of vanishing."""
    analysis = F.pmod("covariate_id", F.lit(1000))
    tagged = covariates.join(analysis_ref.select("analysis_id", "is_binary", "missing_means_zero"), analysis == F.col("analysis_id"), "left")
    unknown = F.raise_error(F.concat(F.lit("analysis without reference: "), analysis.cast("string")))
    tagged = tagged.withColumn("is_binary", F.when(F.col("analysis_id").isNull(), unknown.cast("string")).otherwise(F.col("is_binary")))
    keys = ["cohort_definition_id", "covariate_id"]
    sizes = D.population_sizes(cohort)
    zero = continuous_summary(
        tagged.filter((F.col("is_binary") == "N") & (F.col("missing_means_zero") == "Y")), sizes, keys,
        ["cohort_definition_id"], "covariate_value")
    seen = nonmissing_summary(
        tagged.filter((F.col("is_binary") == "N") & (F.col("missing_means_zero") != "Y")), keys, "covariate_value")
    shares = D.aggregate_flags(tagged.filter(F.col("is_binary") == "Y"), cohort)
    shares = shares.select(*keys, *[
        {"count_value": F.col("sum_value"), "average_value": F.col("average_value")}.get(c, F.lit(None).cast("double")).alias(c)
        for c in SUMMARY_COLUMNS])
    out = None
    for kind, f in (("zero", zero), ("missing", seen), ("binary", shares)):
        f = f.select(*keys, F.lit(kind).alias("kind"), *[
            F.col(c).cast("long" if c == "count_value" else "double").alias(c) for c in SUMMARY_COLUMNS])
        out = f if out is None else out.unionByName(f)
    return out
