"""Sizes, rates and shares as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_bytes(n: Column) -> Column:
    """'17 B', '1.5 KB', ... in steps of 1024; halves go to the even digit."""
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate("KMGTPE", 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}B", F.bround(n / float(1024**k), 1))).otherwise(out)
    return out


def percent(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)


def rate(amount: Column, seconds: Column) -> Column:
    return F.when(seconds == 0, F.lit(0.0)).otherwise(amount / seconds)


def megabits(bytes_: Column, seconds: Column) -> Column:
    """Bytes in so many seconds as Mbit/s, with a megabit of 1024 * 1024."""
    return rate(bytes_ * 8.0, seconds) / (1024 * 1024)


def link_density(links: Column, html_bytes: Column) -> Column:
    """Links per KB; 0 for an empty page."""
    return F.when(html_bytes == 0, F.lit(0.0)).otherwise(links / (html_bytes / 1024.0))
