"""Exact money: integer nanodollars, as Columns and as Python numbers."""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 10**9
MAX_NANOS = 2**63 - 1


def usd_to_nanos(usd, label: str = "usd") -> int:
    """Dollars to nanodollars, fractions up. Truth values, NaN, infinities and negatives are refused."""
    if isinstance(usd, bool):
        raise ValueError(f"{label} is a truth value, not an amount")
    try:
        amount = Decimal(str(usd))
    except (InvalidOperation, ValueError) as e:
        raise ValueError(f"{label} is no amount: {usd!r}") from e
    if amount < 0 if amount.is_finite() else True:
        raise ValueError(f"{label} must be finite and not negative")
    nanos = int((amount * NANOS).to_integral_value(ROUND_CEILING))
    if nanos > MAX_NANOS:
        raise ValueError(f"{label} is beyond {MAX_NANOS} nanodollars")
    return nanos


def nanos_to_usd(nanos: int) -> Decimal:
    return Decimal(nanos) / NANOS


def charge_nanos(tokens: int, rate: int) -> int:
    """Nanodollars for tokens at a rate for a million of them, fractions up."""
    total = -(-tokens * rate // 1_000_000)
    if total > MAX_NANOS:
        raise ValueError("a charge is beyond what a ledger holds")
    return total


def usd_to_nanos_column(usd: Column) -> Column:
    return F.ceil(usd.cast("decimal(38,18)") * F.lit(NANOS)).cast("bigint")


def nanos_to_usd_column(nanos: Column) -> Column:
    return (nanos.cast("decimal(38,0)") / F.lit(NANOS).cast("decimal(10,0)")).cast("decimal(38,9)")


def charge_nanos_column(tokens: Column, rate: Column) -> Column:
    exact = tokens.cast("decimal(20,0)") * rate.cast("decimal(18,0)")
    return F.ceil(exact / F.lit(1_000_000).cast("decimal(7,0)")).cast("bigint")
