"""Spend analytics over ledger events (model.USAGE), and price arithmetic in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIVE = ("reserved", "committed")


def expired(events: DataFrame, now: Column) -> DataFrame:
    """Reservations whose time is over are expired."""
    return events.withColumn("status", F.when((F.col("status") == "reserved") & (F.col("expires_at") <= now), "expired").otherwise(F.col("status")))


def spent(events: DataFrame, day: Column | None = None, month: Column | None = None) -> DataFrame:
    """One row: reserved and committed nanodollars of a day, or of the month that a date lies in."""
    live = events.filter(F.col("status").isin(*LIVE))
    if day is not None:
        live = live.filter(F.col("date") == day)
    if month is not None:
        start = F.trunc(month, "month")
        live = live.filter((F.col("date") >= start) & (F.col("date") < F.add_months(start, 1)))
    return live.agg(F.coalesce(F.sum("charge_nanos"), F.lit(0)).cast("long").alias("nanos"))


def tokens(events: DataFrame, day: Column, provider: str, model: str | None = None) -> DataFrame:
    used = events.filter((F.col("status") == "committed") & (F.col("date") == day) & (F.col("provider") == provider))
    if model is not None:
        used = used.filter(F.col("model") == model)
    return used.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))
