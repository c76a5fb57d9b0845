"""Column expressions shared by the operators."""

from innsight.functions.expressions import (
    beyond_money,
    field_rank,
    full_name,
    greatest_strict,
    half_open,
    hours_between,
    money,
    month_nights,
    month_of,
    nights,
    ntz,
    percentage,
    ratio,
    text_key,
    total_money,
    vip_level,
    whole_days,
)

__all__ = [
    "beyond_money",
    "field_rank",
    "full_name",
    "greatest_strict",
    "half_open",
    "hours_between",
    "money",
    "month_nights",
    "month_of",
    "nights",
    "ntz",
    "percentage",
    "ratio",
    "text_key",
    "total_money",
    "vip_level",
    "whole_days",
]
