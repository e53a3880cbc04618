"""All queries on the relational and text tables: importing the modules registers them."""

from tallyward.plans import detector_queries, discovery_queries, package_queries, stream_queries  # noqa: F401
from tallyward.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
