"""Union-find grouping; the library proper has it."""

from __future__ import annotations

from ..plans.components import components

__all__ = ["components"]
