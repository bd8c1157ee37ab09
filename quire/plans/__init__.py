"""Named plans over the test tables, each with the SQL it must equal."""

from .registry import PLANS, Tables, plan
from . import projections, scans, classify, joins, aggregates, ordering, setops, quality, search, maintenance, intake

__all__ = ["PLANS", "Tables", "plan"]
