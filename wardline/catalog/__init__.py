"""All registered queries."""

from wardline.catalog import aggregates, cohorts, detectors, invariants, joins, models, plans, scalars, tables, windows  # noqa: F401
from wardline.catalog.registry import ORACLES, QUERIES  # noqa: F401
