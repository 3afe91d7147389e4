"""All checked queries; importing the modules registers them."""

from tideledger.plans import aggs, fits, joins, losses, scans, searches, windows  # noqa: F401
from tideledger.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
