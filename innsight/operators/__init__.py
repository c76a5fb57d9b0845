"""Reports, reconciliation and data quality over a ``Hotel``."""

from innsight.operators import billing, bookings, guests, occupancy, quality, reconcile, services, staff

__all__ = ["billing", "bookings", "guests", "occupancy", "quality", "reconcile", "services", "staff"]
