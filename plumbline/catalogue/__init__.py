"""Named queries over the test tables, each with the SQL that must agree."""

from plumbline.catalogue import aggregates, alerts, checks, functions, joins, rules, streams  # noqa: F401
from plumbline.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
