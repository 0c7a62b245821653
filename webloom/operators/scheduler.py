"""Download scheduling over network interfaces: dedupe, assignment, admission, retries, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.config import DEFAULT
from webloom.sources.tables import saved


def pending(tasks: DataFrame, downloaded: DataFrame, queued: DataFrame, url: str = "url") -> DataFrame:
    """Tasks whose raw URL is neither downloaded nor queued; one of each URL."""
    known = downloaded.select(url).union(queued.select(url)).distinct()
    return tasks.dropDuplicates([url]).join(known, url, "left_anti")


def numbered(tasks: DataFrame, *order: str, into: str = "seq") -> DataFrame:
    """``tasks`` with a dense number from 1 in the order of columns, without one task holding all rows.

    Rows are dealt by range; a partition's rows are numbered by a window inside it, and shifted by the counts of the
    partitions before, of which there are few. The dealt rows are written first: both branches then see the same
    partitions, whichever executors are lost in between.
    """
    part = saved(tasks.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = part.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return inside.join(F.broadcast(before), "_part").withColumn(into, (F.col("_row") + F.col("_before")).cast("long")).drop("_part", "_row", "_before")


def round_robin(tasks: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The interface of each task: its number modulo ``n``; the first task thus goes to 1 % n."""
    return tasks.withColumn("iface", (F.col(seq) % n).cast("int"))


def admitted(tasks: DataFrame, n: int, queue: int = DEFAULT.interface_queue, priority: int = DEFAULT.priority_queue, seq: str = "seq") -> DataFrame:
    """Where each task goes: its interface's queue of ``queue // n``, else the priority queue, else 'overflow'.

    The place in an interface's queue is ``ceil(seq / n)`` or so by arithmetic on the dense number, so no window is
    needed; the overflow of the interfaces takes the priority queue in order of ``seq``.
    """
    each = queue // n
    dealt = round_robin(tasks, n, seq)
    # Numbers run from 1, so interface i > 0 gets i, i + n, ...; interface 0 gets n, 2n, ...
    place = F.when(F.col("iface") == 0, F.floor(F.col(seq) / n)).otherwise(F.floor((F.col(seq) - F.col("iface")) / n) + 1)
    return dealt.withColumn("place", place.cast("long")).withColumn("queue", F.when(F.col("place") <= each, "iface").when(F.col(seq) - each * n <= priority, "priority").otherwise("overflow"))


def tries(attempts: DataFrame, *task: str, order: tuple[str, ...] = ("ts",), ok: str = "ok", retries: int = DEFAULT.retries, backoff_ms: int = DEFAULT.backoff_ms) -> DataFrame:
    """The attempts that are made: up to the first success, and at most 1 + ``retries``, with linear backoff."""
    w = Window.partitionBy(*task).orderBy(*order)
    done = F.coalesce(F.max(F.col(ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = attempts.withColumn("attempt", F.row_number().over(w)).withColumn("_done", done)
    out = out.where((F.col("_done") == 0) & (F.col("attempt") <= retries + 1)).drop("_done")
    return out.withColumn("backoff_ms", ((F.col("attempt") - 1) * backoff_ms).cast("long"))


def final_states(made: DataFrame, *task: str, ok: str = "ok") -> DataFrame:
    """The state of each task after its tries: downloaded, or failed once its tries are used up; else pending."""
    n = made.groupBy(*task).agg(F.count("*").alias("attempts"), F.count_if(~F.col(ok)).alias("failures"), F.max(F.col(ok).cast("int")).alias("_ok"))
    return n.withColumn("state", F.when(F.col("_ok") == 1, "downloaded").when(F.col("attempts") > DEFAULT.retries, "failed").otherwise("pending")).drop("_ok")


def initial_workers(interfaces: DataFrame, n: int, start: int = DEFAULT.start_workers) -> DataFrame:
    """``interfaces`` (worker_count, ...) with the workers that each starts with."""
    return interfaces.withColumn("workers", F.least(F.col("worker_count").cast("long"), F.lit(start // n + 100).cast("long")))


def added_workers(interfaces: DataFrame, n: int, count: str = "count", number: str = "iface") -> DataFrame:
    """``count`` new workers shared out: equal parts, the remainder to the first interfaces."""
    return interfaces.withColumn("added", (F.floor(F.col(count) / n) + F.when(F.col(number) < F.col(count) % n, 1).otherwise(0)).cast("long"))


def persistent(tasks: DataFrame, n: int, priority_free: int, iface_free: int, tries: int = DEFAULT.enqueue_tries, backoff_ms: int = DEFAULT.enqueue_backoff_ms, rank: str = "rank") -> DataFrame:
    """Where tasks that overflowed end up: (..., attempt, queue, waited_ms).

    Each task (a dense ``rank`` from 1) tries ``tries`` times, waiting ``backoff_ms`` longer each time. Before each
    round ``priority_free`` places of the priority queue and ``iface_free`` of each interface's come free; the
    priority queue is filled first, then the interfaces in their order. Whoever finds no place in any round is
    dropped (attempt null). By arithmetic on the rank, so nothing is simulated and no window is needed.
    """
    a_round = priority_free + n * iface_free
    zero = F.col(rank) - 1
    attempt, place = F.floor(zero / a_round), zero % a_round
    kept = attempt < tries
    where = F.when(place < priority_free, F.lit("priority")).otherwise(F.concat(F.lit("iface "), F.floor((place - priority_free) / max(iface_free, 1)).cast("string")))
    last = F.when(kept, attempt).otherwise(F.lit(tries - 1))
    return tasks.withColumn("attempt", F.when(kept, attempt.cast("int"))).withColumn("queue", F.when(kept, where).otherwise("dropped")).withColumn("waited_ms", (last * (last + 1) / 2 * backoff_ms).cast("long"))


def pulled(queues: DataFrame, n: int, queue: int = DEFAULT.interface_queue, seq: str = "seq") -> DataFrame:
    """The order in which workers take what ``admitted`` has queued: (..., puller, turn).

    In each turn every interface takes one task: the priority queue's next, while there is one, and its own queue's
    next after that, both first in, first out. Tasks that overflowed are not taken.
    """
    each = queue // n
    first = queues.agg(F.count_if(F.col("queue") == "priority").alias("_n"))
    out = queues.where("queue <> 'overflow'").crossJoin(F.broadcast(first))  # one row
    ahead = F.col(seq) - each * n - 1  # of a task in the priority queue: how many came before
    taken = F.floor((F.col("_n") - F.col("iface") + n - 1) / n)  # tasks that its interface takes from there
    mine = F.col("queue") == "priority"
    return out.withColumn("puller", F.when(mine, ahead % n).otherwise(F.col("iface")).cast("int")).withColumn("turn", F.when(mine, F.floor(ahead / n)).otherwise(taken + F.col("place") - 1).cast("long")).drop("_n")


def queue_totals(queues: DataFrame, n: int, queue: int = DEFAULT.interface_queue, priority: int = DEFAULT.priority_queue) -> DataFrame:
    """One row: tasks in all queues, and what the queues hold."""
    return queues.agg(F.count_if(F.col("queue") != "overflow").alias("queued")).withColumn("capacity", F.lit(priority + n * (queue // n)).cast("long"))


def with_interfaces(tasks: DataFrame, interfaces: DataFrame, *columns: str) -> DataFrame:
    """Each task with ``columns`` of its interface; the interfaces of a machine are few."""
    return tasks.join(F.broadcast(interfaces.select("iface", *columns)), "iface")


def rediscovered(states: DataFrame, *order: str, url: str = "url") -> DataFrame:
    """``states`` (url, state, ...) with whether the task was queued at all: only if all of its URL before had failed.

    A failed URL may be queued again when it is found again; a downloaded or pending one is not.
    """
    w = Window.partitionBy(url).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return states.withColumn("enqueued", F.coalesce(F.max((F.col("state") != "failed").cast("int")).over(w), F.lit(0)) == 0)


def rate_limited(tasks: DataFrame, per_second: int = DEFAULT.rate, burst: int = DEFAULT.burst, seq: str = "seq") -> DataFrame:
    """How long each task waits for a token, in microseconds, when all ask at once: ``burst`` go, then a steady rate."""
    return tasks.withColumn("wait_us", F.greatest(F.lit(0), (F.col(seq) - burst) * (1_000_000 // per_second)).cast("long"))


def client_of(worker: Column, clients: int = DEFAULT.clients) -> Column:
    """The client that an interface's worker of this number uses."""
    return (worker % clients).cast("int")
