"""All queries of the rollout engine."""

from __future__ import annotations

from tallyforge.plans import queries_admission, queries_cadence, queries_groups, queries_protocol, queries_scans, queries_scoring, queries_selection, queries_streams, queries_text, queries_vectors  # noqa: F401 - they register
from tallyforge.plans.base import REGISTRY

FLAGSHIP = "ema_burn_weights"
__all__ = ["FLAGSHIP", "REGISTRY"]
