"""Named queries over the driver's tables, each beside the SQL that defines its result."""

from tallycast.catalog import panels, covariates, instances, models, evaluation  # noqa: F401
from tallycast.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
