"""Batch appliers: a table of requests in; new rows, changed rows and refusals out."""

from innsight.plans.booking import book, check_availability, expire_bookings, first_come, validate_booking_dates
from innsight.plans.cancel import cancel, cancellation_effects
from innsight.plans.checkout import checkout
from innsight.plans.rooms import check_in, room_state_log, set_room_state
from innsight.plans.services import register_services, validate_consumption, validate_service_prices
from innsight.plans.vip import count_bookings, enrol_vip, propose_upgrades, recompute_vip, upgrade

__all__ = [
    "book",
    "cancel",
    "cancellation_effects",
    "check_availability",
    "check_in",
    "checkout",
    "count_bookings",
    "enrol_vip",
    "expire_bookings",
    "first_come",
    "propose_upgrades",
    "recompute_vip",
    "register_services",
    "room_state_log",
    "set_room_state",
    "upgrade",
    "validate_booking_dates",
    "validate_consumption",
    "validate_service_prices",
]
