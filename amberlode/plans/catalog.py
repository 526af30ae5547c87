"""All registered queries of the library's own operators, and their checking SQL."""

from __future__ import annotations

from amberlode.plans import aggregates, facts, filters, joins, kernels, ranking, retrieval, scans, streams  # noqa: F401
from amberlode.plans.registry import ORACLES, QUERIES  # noqa: F401
