"""Structured Streaming jobs for the logic that follows from single-row changes."""

from innsight.streaming._common import LatestRows, drain, file_stream, work_dir
from innsight.streaming.consumption import (
    consumption_by_service_window,
    consumption_windows,
    run_consumption_validator,
    run_consumption_windows,
)
from innsight.streaming.counters import booking_counters, booking_counters_stream, run_booking_counters
from innsight.streaming.room_log import RoomLog

__all__ = [
    "LatestRows",
    "RoomLog",
    "booking_counters",
    "booking_counters_stream",
    "consumption_by_service_window",
    "consumption_windows",
    "drain",
    "file_stream",
    "run_booking_counters",
    "run_consumption_validator",
    "run_consumption_windows",
    "work_dir",
]
