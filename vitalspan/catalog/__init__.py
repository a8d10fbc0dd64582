"""All registered queries."""

from __future__ import annotations

from vitalspan.catalog.registry import REGISTRY, Query


def load() -> dict[str, Query]:
    """Import every catalog module and return the registry."""
    from vitalspan.catalog import (  # noqa: F401
        q_cohorts, q_covariates, q_eras, q_filters, q_joins, q_models, q_prediction, q_reshape, q_sources, q_windows,
    )

    return REGISTRY
