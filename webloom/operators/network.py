"""Interfaces as data: speed, workers, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def speed_name(mbps: Column, name: Column) -> Column:
    """'10GbE', '100MbE', ... of a speed in Mbit/s; by the interface's name where it is unknown."""
    known = F.when(mbps >= 1000, F.concat(F.floor(mbps / 1000).cast("string"), F.lit("GbE"))).otherwise(F.concat(mbps.cast("string"), F.lit("MbE")))
    return F.when(mbps.isNotNull(), known).when(name.startswith("enp3s0f"), "10GbE").when(name.startswith("enp9s0"), "1GbE").otherwise("Unknown")


def configured(interfaces: DataFrame) -> DataFrame:
    """``interfaces`` (name, speed_mbps) with speed, worker_count and bandwidth; the text of the speed decides."""
    s = F.col("speed")
    return interfaces.withColumn("speed", speed_name(F.col("speed_mbps"), F.col("name"))).withColumns({
        "worker_count": F.when(s.contains("10G"), 2000).when(s.contains("1G"), 500).otherwise(200).cast("long"),
        "bandwidth_mbps": F.when(s.contains("10G"), 10000).when(s.contains("1G"), 1000).otherwise(100).cast("long"),
    })


def selected(interfaces: DataFrame, choice: str, number: str = "number") -> DataFrame:
    """Active interfaces: 'all', or those of a comma-separated list of numbers from 1."""
    active = interfaces.where("is_active")
    if choice.strip().lower() == "all":
        return active
    numbers = [int(x) for x in choice.split(",") if x.strip().isdigit()]
    return active.where(F.col(number).isin(numbers))


def totals(configured_: DataFrame) -> DataFrame:
    return configured_.agg(F.count_if("is_active").alias("active"), F.coalesce(F.sum("bandwidth_mbps"), F.lit(0)).cast("long").alias("total_mbps"))
