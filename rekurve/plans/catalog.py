"""All registered queries."""

from rekurve.plans import catalog_curves, catalog_fits, catalog_learn, catalog_space, catalog_stats, catalog_tables  # noqa: F401
from rekurve.plans.registry import ORACLES, QUERIES  # noqa: F401
