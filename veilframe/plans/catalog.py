"""All queries and their oracles."""

from __future__ import annotations

from . import q_boxes, q_frames, q_ops, q_privacy, q_records, q_text  # noqa: F401
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
