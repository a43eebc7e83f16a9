"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from packlake.session import spread, table

__all__ = ["spread", "table"]
