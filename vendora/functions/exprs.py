"""Scalar column expressions of the shop's domain (all JVM built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gross_margin(price: Column, cogs: Column) -> Column:
    """(price - cogs) / price; null when price is 0 (ANSI-safe)."""
    return F.try_divide(price - cogs, price)


def line_revenue(quantity: Column, unit_price: Column) -> Column:
    return quantity * unit_price


def log_target(y: Column) -> Column:
    """ln(max(y, 1)): zero and negative days map to 0."""
    return F.log(F.greatest(y.cast("double"), F.lit(1.0)))


def from_log(p: Column) -> Column:
    return F.exp(p)


def clip_floor(x: Column, floor: float = 0.0) -> Column:
    return F.greatest(x, F.lit(floor))


def round_money(x: Column, digits: int = 2) -> Column:
    return F.round(x, digits)
