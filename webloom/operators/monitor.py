"""Counters, reports and scaling decisions over fetch attempts (ts, ok, bytes, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.config import DEFAULT
from webloom.functions import figures


def utilization(queued: Column, capacity: Column) -> Column:
    return F.when(capacity == 0, F.lit(0.0)).otherwise(queued / capacity)


def scale_up(queued: Column, capacity: Column, workers: Column, most: int = DEFAULT.max_workers) -> Column:
    """Workers to add: 300, 600 or 1200 above 40, 60 or 80 % utilization, never past ``most``."""
    u = utilization(queued, capacity)
    wanted = F.when(u > 0.8, 1200).when(u > 0.6, 600).when(u > 0.4, 300).otherwise(0)
    return F.when(workers < most, F.least(wanted, most - workers)).otherwise(0).cast("long")


def force_scale_up(workers: Column, most: int = DEFAULT.max_workers) -> Column:
    return F.greatest(F.least(F.lit(900), most - workers), F.lit(0)).cast("long")


def counters() -> list[Column]:
    """Attempts, successes, failures and bytes of a group of attempts."""
    return [F.count("*").alias("attempts"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0.0)).alias("bytes")]


def report(attempts: DataFrame) -> DataFrame:
    """One row: counters, success in percent, downloads and Mbit a second over the whole span."""
    n = attempts.agg(*counters(), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("micros"))
    s = F.coalesce(F.col("micros"), F.lit(0)) / 1e6
    return n.select("attempts", "success", "failed", F.round("bytes", 4).alias("bytes"), F.round(figures.percent(F.col("success"), F.col("attempts")), 6).alias("success_percent"), F.round(figures.rate(F.col("success"), s), 8).alias("downloads_per_s"), F.round(figures.megabits(F.col("bytes"), s), 10).alias("mbps"))


def windows(attempts: DataFrame, width: str = "1 day") -> DataFrame:
    """Counters by tumbling window."""
    return attempts.groupBy(F.window("ts", width).alias("w")).agg(*counters()).select(F.col("w.start").alias("start"), "attempts", "success", "failed", F.round("bytes", 4).alias("bytes"))


def network_report(attempts: DataFrame, queue: int) -> DataFrame:
    """Per interface: what is queued, and the share of its queue in percent."""
    return attempts.groupBy("iface").agg(F.count("*").alias("queued")).withColumn("percent", F.round(utilization(F.col("queued"), F.lit(queue)) * 100.0, 6))


def interface_queues(interfaces: DataFrame, queues: DataFrame, queue: int, n: int) -> DataFrame:
    """Each interface (iface, name, speed) with what is in its queue, what that holds, and the share in percent."""
    held = queues.where("queue = 'iface'").groupBy("iface").agg(F.count("*").alias("queued"))
    out = interfaces.join(held, "iface", "left").withColumn("queued", F.coalesce("queued", F.lit(0))).withColumn("capacity", F.lit(queue // n).cast("long"))
    return out.select("iface", "name", "speed", "queued", "capacity", F.round(utilization(F.col("queued"), F.col("capacity")) * 100.0, 6).alias("percent"))


def failures(states: DataFrame, url: str) -> DataFrame:
    """Of each URL with one: its tasks that used up all their tries. A try that is followed by another counts not.

    Of ``states`` from ``scheduler.rediscovered`` only tasks that were queued at all are counted.
    """
    failed = F.col("state") == "failed"
    return states.where(failed & F.col("enqueued") if "enqueued" in states.columns else failed).groupBy(url).agg(F.count("*").alias("failures"))


def first_lines(df: DataFrame, by: str, *order: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows of each ``by``, numbered: what a log prints before it falls silent. Cut in each task first."""
    return df.withColumn("line", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("line") <= n)


def every(numbered: DataFrame, step: int, seq: str = "seq", coarse: int = 10_000) -> DataFrame:
    """(attempts, success, failed): the running counters at each ``step`` attempts.

    ``numbered`` has a dense ``seq`` from 1 and ok. Sums of steps are added up in two levels, so that no task gets
    more than ``coarse`` steps or the sums of these.
    """
    steps = numbered.groupBy(F.floor((F.col(seq) - 1) / step).alias("s")).agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))
    steps = steps.withColumn("c", F.floor(F.col("s") / coarse))
    upper = steps.groupBy("c").agg(F.sum("ok").alias("ok")).select("c", (F.sum("ok").over(Window.orderBy("c")) - F.col("ok")).alias("before"))
    inside = F.sum("ok").over(Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    out = steps.where(F.col("n") == step).withColumn("inside", inside).join(upper, "c").withColumn("attempts", (F.col("s") + 1) * step).withColumn("success", F.col("inside") + F.col("before"))
    return out.select("attempts", "success", (F.col("attempts") - F.col("success")).alias("failed"))


def scale_ticks(ticks: DataFrame, time: str, start: int = DEFAULT.start_workers, most: int = DEFAULT.max_workers) -> DataFrame:
    """``ticks`` (time, queued, capacity) with the workers after each: what ticks add is summed up to ``most``.

    Ticks are one per interval of a crawl, hence few: one window holds them.
    """
    wanted = scale_up(F.col("queued"), F.col("capacity"), F.lit(0), 10**9)
    return ticks.withColumn("workers", F.least(F.lit(most), start + F.sum(wanted).over(Window.orderBy(time))).cast("long"))


def final_report(attempts: DataFrame, interfaces: DataFrame) -> DataFrame:
    """One row: the counters, bytes as text, downloads and Mbit a second, workers (a column of ``interfaces``) and interfaces."""
    made = report(attempts).withColumn("size", figures.format_bytes(F.floor("bytes")))
    return made.crossJoin(F.broadcast(interfaces.agg(F.sum("workers").alias("workers"), F.count("*").alias("interfaces"))))  # one row each


def path_lines(stats: DataFrame) -> DataFrame:
    """(line): what a log says of each path (route, n_pages, avg_us, n_links, n_docs)."""
    return stats.select(F.format_string("%s path: %d pages, %d us on average, %d links, %d documents", "route", "n_pages", "avg_us", "n_links", "n_docs").alias("line"))


def first_failures(attempts: DataFrame, *order: str, n: int = DEFAULT.logged_failures) -> DataFrame:
    """The first ``n`` failed attempts, numbered: what a log prints before it falls silent. Cut in each task first."""
    some = attempts.where("NOT ok").orderBy(*order).limit(n)
    return some.withColumn("line", F.row_number().over(Window.orderBy(*order)))  # n rows


def sketches(links: DataFrame, url: str, *by: str, lg: int = 12) -> DataFrame:
    """A HyperLogLog sketch of the distinct URLs of each group: some KB, whatever their number. Estimates are within about 1 / 2^(lg/2)."""
    return links.groupBy(*by).agg(F.hll_sketch_agg(url, F.lit(lg)).alias("sketch"))


def merged(made: DataFrame, *by: str) -> DataFrame:
    """Sketches of finer groups as those of coarser ones, without the URLs; without ``by``, of all."""
    return made.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(made: DataFrame, into: str = "n_distinct") -> DataFrame:
    """The sketches' numbers of distinct URLs."""
    return made.withColumn(into, F.hll_sketch_estimate("sketch")).drop("sketch")
