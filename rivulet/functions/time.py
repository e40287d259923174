"""Time helpers."""

from __future__ import annotations

_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def week_offset(first_day: str) -> str:
    """Offset that makes seven-day windows start on a weekday; the epoch was a Thursday."""
    return f"{_DAYS.index(first_day.lower()) - 3} days"
