"""Registered queries over the provided tables."""

from synapta.plans import connectivity, inference, models, screening, tables  # noqa: F401  they register themselves
from synapta.plans.base import ORACLES, QUERIES  # noqa: F401
