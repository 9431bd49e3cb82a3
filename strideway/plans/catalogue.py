"""All queries, and SQL for those that SQL can tell."""

from __future__ import annotations

from strideway.plans import queries_io, queries_signal  # noqa: F401  their queries register themselves
from strideway.plans.oracles import ORACLES as _PLANS
from strideway.plans.oracles_more import ORACLES as _MORE
from strideway.plans.queries import QUERIES

ORACLES = _PLANS | _MORE

__all__ = ["ORACLES", "QUERIES"]
