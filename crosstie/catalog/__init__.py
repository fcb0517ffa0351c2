"""All registered queries."""

from crosstie.catalog import files, relations, rows, spatial  # noqa: F401  (registration)
from crosstie.catalog.registry import ORACLES, QUERIES, oracle, runnable  # noqa: F401
