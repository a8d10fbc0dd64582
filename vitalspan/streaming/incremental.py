"""Incremental cohort generation: only new or changed definitions run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.plans.cohorts import CohortDefinition, build_cohorts
from vitalspan.session import literal_frame, materialize
from vitalspan.sources.snapshots import Snapshots
from vitalspan.sources.store import upsert_cohorts

_MANIFEST = "cohort_definition_id long, checksum string, run int"


def _manifest(spark: SparkSession, folder: str) -> Snapshots:
    return Snapshots(spark, f"{folder}/manifest", _MANIFEST)


def generate_incrementally(cdm, definitions: Sequence[CohortDefinition], folder: str) -> list[int]:
    """Build definitions whose checksum is not recorded yet, replace their
    rows, then record them. Returns the ids that ran.

    The manifest holds one row per definition, whatever the number of runs; it
    is joined by definition, and replaced as a whole after the rows: a run
    that dies in between repeats the work and replaces the same rows.
    """
    spark, manifest = cdm.spark, _manifest(cdm.spark, folder)
    before = manifest.current()
    known = manifest.read(before)
    asked = literal_frame(spark, [(d.cohort_definition_id, d.checksum()) for d in definitions], "cohort_definition_id long, checksum string")
    new = {r[0] for r in asked.join(known, ["cohort_definition_id", "checksum"], "left_anti").select("cohort_definition_id").collect()}
    todo = [d for d in definitions if d.cohort_definition_id in new]
    if not todo:
        return []
    ids = [d.cohort_definition_id for d in todo]
    upsert_cohorts(materialize(build_cohorts(cdm, todo), "cohorts"), f"{folder}/cohort", ids)
    run = 1 + (known.agg(F.max("run")).first()[0] or 0)
    rows = literal_frame(spark, [(d.cohort_definition_id, d.checksum(), run) for d in todo], _MANIFEST)
    manifest.commit(known.join(rows.select("cohort_definition_id"), "cohort_definition_id", "left_anti").select(*rows.columns).unionByName(rows), before)
    return ids


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The last checksum of every definition and the run that built it."""
    return _manifest(spark, folder).read()
