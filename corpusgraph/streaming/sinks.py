"""Streaming sinks: a log of pending rows (``pending_log``), recompile only on change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.fingerprint import scan_fingerprint
from .pending_log import PendingLog, pending_log

__all__ = ["PendingLog", "pending_log", "rebuild_on_change"]


def rebuild_on_change(scan: DataFrame, known: str | None, rebuild: Callable[[DataFrame], object]) -> str:
    """Rebuild where the scan's fingerprint moved; returns the fingerprint."""
    now = scan_fingerprint(scan)
    if now != known:
        rebuild(scan)
    return now
