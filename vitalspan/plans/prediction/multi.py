"""Many designs over shared data: targets x outcomes x covariate settings x
populations x models, with a written manifest of finished ones."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.plans.prediction import evaluate as E
from vitalspan.plans.prediction.models import Learner
from vitalspan.plans.prediction.population import PopulationSpec, outcome_days, study_population
from vitalspan.plans.prediction.split import SplitSpec, split
from vitalspan.session import concurrently, literal_frame, materialize, path_exists

#: Result of a design, one row.
RESULT = "design string, target_id long, outcome_id long, covariates string, model string, risk_end int, rows long, outcomes long, auc double"


@dataclass(frozen=True)
class Design:
    """``model`` is a learner whose text form names its settings;
    ``covariates`` names a covariate setting."""

    target_id: int
    outcome_id: int
    population: PopulationSpec
    model: Learner
    covariates: str = "all"

    def key(self) -> str:
        return json.dumps([self.target_id, self.outcome_id, self.covariates, repr(self.population), repr(self.model)])

    def digest(self) -> str:
        return hashlib.sha256(self.key().encode()).hexdigest()[:24]

    def name(self) -> str:
        return getattr(self.model, "kind", type(self.model).__name__)


def designs(targets: Sequence[int], outcomes: Sequence[int], populations: Sequence[PopulationSpec], models: Sequence[Learner],
            restrict: Callable[[Design], bool] = lambda d: d.target_id != d.outcome_id, covariates: Sequence[str] = ("all",)) -> list[Design]:
    """All combinations that a restriction on the whole design lets pass."""
    every = (Design(t, o, p, m, c) for t, o, c, p, m in product(targets, outcomes, covariates, populations, models))
    return [d for d in every if restrict(d)]


def finished(spark, manifest: str) -> DataFrame:
    """Results of the designs that a manifest holds. A design whose run ended
    before its row was committed is not among them."""
    if not path_exists(spark, manifest):
        return literal_frame(spark, [], RESULT)
    return spark.read.schema(RESULT).option("recursiveFileLookup", "true").parquet(manifest)


def run_multiple(
    rows: DataFrame, covariates: DataFrame | Mapping[str, DataFrame], cohort: DataFrame, todo: Sequence[Design], split_spec: SplitSpec = SplitSpec(),
    manifest: str | None = None, workers: int = 4, done: set[str] = frozenset(),
) -> DataFrame:
    """Performance of every design on its test rows.

    Target rows, outcomes and each covariate setting are extracted once for
    all designs that need them; designs run side by side, ``workers`` at a
    time. With a ``manifest`` folder every design's row is committed there as
    soon as it is known, under the digest of its settings; a later call with
    the same folder runs only what is missing and returns the rows of all of
    ``todo``. Designs whose key is in ``done`` are skipped altogether.
    """
    spark = rows.sparkSession
    settings = covariates if isinstance(covariates, Mapping) else {"all": covariates}
    todo = [d for d in todo if d.key() not in done]
    before = {r["design"] for r in finished(spark, manifest).select("design").collect()} if manifest else set()
    left = [d for d in todo if d.digest() not in before]
    results: list[tuple] = []
    if left:
        rows = materialize(rows, "targets")
        needed = {name: materialize(settings[name], "covariates") for name in dict.fromkeys(d.covariates for d in left)}
        events = materialize(outcome_days(cohort, sorted({d.outcome_id for d in left})), "outcomes")

        def job(d: Design) -> Callable[[], tuple]:
            def run() -> tuple:
                target = rows.filter(F.col("cohort_definition_id") == d.target_id)
                pop = study_population(target, events, d.outcome_id, d.population)
                pop = materialize(pop.join(split(pop, split_spec), "row_id"), "population")
                frame = needed[d.covariates]
                scored = d.model.fit(frame, pop.filter(F.col("index") > 0)).predict(frame, pop.filter(F.col("index") < 0))
                n, y = pop.agg(F.count(F.lit(1)), F.sum("outcome_count")).first()
                auc = E.auc(scored).first()["auc"]
                row = (d.digest(), d.target_id, d.outcome_id, d.covariates, d.name(), d.population.risk_end, int(n), int(y or 0), None if auc is None else float(auc))
                if manifest:
                    literal_frame(spark, [row], RESULT).coalesce(1).write.mode("overwrite").parquet(f"{manifest}/{d.digest()}")
                return row
            return run

        results = concurrently(spark, [job(d) for d in left], workers)
    if manifest is None:
        return literal_frame(spark, results, RESULT)
    wanted = literal_frame(spark, [(d.digest(),) for d in todo], "design string")
    return finished(spark, manifest).join(wanted, "design", "left_semi")


def with_risk_ends(spec: PopulationSpec, ends: Sequence[int]) -> list[PopulationSpec]:
    """The same population for several ends of the time at risk."""
    return [replace(spec, risk_end=e) for e in ends]


def external_validation(model, covariates: DataFrame, population: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply a model to another database's rows: (prediction, statistics)."""
    scored = materialize(model.predict(covariates, population), "validation")
    return scored, E.evaluation_statistics(scored)
