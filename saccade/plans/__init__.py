"""Jobs, fixture views and registered queries."""

from saccade.plans import (  # noqa: F401
    q_boxes, q_jobs, q_mapping, q_masks, q_metrics, q_prompts, q_scalar, q_sources, q_streaming, q_sync,
)
from saccade.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
