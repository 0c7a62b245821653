"""Retries that wait: against a plain simulation, over many batches, with a state that stays small."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest

from webloom.streaming import retries, streams

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
HOUR = 3_600_000_000


def us(t):
    return round((t - START).total_seconds() * 1e6)


def simulated(rows, most, backoff, keep, mark):
    """All that happens, a URL at a time: due times and endings, up to ``mark`` where no outcome follows."""
    out = []
    for url in {r[0] for r in rows}:
        tries, due, called, rest = 0, None, False, None
        for at, ok in [*sorted((us(t), ok) for u, t, ok in rows if u == url), (None, None)]:
            now = mark - 1 if at is None else at
            if due is not None and due <= now:
                if not called:
                    out.append((url, "retry", tries, due))
                    called = True
                if due + keep <= now:
                    out.append((url, "lost", tries, due + keep))
                    tries, due = 0, None
            if at is None or rest is not None and at < rest or due is not None and at < due:
                continue
            rest, tries = None, tries + 1
            if ok:
                out.append((url, "downloaded", tries, at))
                tries, due, rest = 0, None, at + keep
            elif tries > most:
                out.append((url, "failed", tries, at))
                tries, due = 0, None
            else:
                due, called = at + backoff * tries, False
    return sorted(out)


def source(spark, folder, rows, files):
    """The rows in so many files, by time, which a stream takes one after the other."""
    rows = sorted(rows, key=lambda r: r[1] or START)
    for k in range(files):
        spark.createDataFrame(rows[k * len(rows) // files : (k + 1) * len(rows) // files], "url string, ts timestamp, ok boolean").coalesce(1).write.mode("append").parquet(str(folder))
        new = max(folder.glob("*.parquet"), key=lambda f: f.stat().st_ctime_ns)
        os.utime(new, (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema("url string, ts timestamp, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("files", [1, 5])
def test_against_a_simulation(spark, tmp_path, files):
    rng = random.Random(files)
    rows = []
    for u in range(25):
        t = START
        for _ in range(rng.randrange(1, 25)):
            t += timedelta(microseconds=rng.choice([1, 200_000, 299_999, 300_000, 600_000, 900_000, 10**7, HOUR, 5 * HOUR]))
            rows.append((f"u{u}", t, rng.random() < 0.25))
    stream = source(spark, tmp_path / "in", [*rows, (None, START, True), ("n", None, True), ("n", START, None)], files)
    with retries.timed_state(spark):
        got = streams.drained(retries.retries(stream, delay="2 hours", keep_ms=3 * HOUR // 1000)).collect()
    mark = us(max(t for _, t, _ in rows)) // 1000 * 1000 - 2 * HOUR
    want = simulated(rows, 3, 300_000, 3 * HOUR, mark)
    assert sorted((r.url, r.event, r.tries, us(r.happened.replace(tzinfo=timezone.utc))) for r in got) == want
    assert {"retry", "lost", "downloaded", "failed"} == {w[1] for w in want}


def test_state_stays_small(spark, tmp_path):
    """Each day other URLs; what ended or was given up is forgotten a day later, so the state never holds all."""
    rows = [(f"d{day}-{i}", START + timedelta(days=day, minutes=i), i % 3 == 0) for day in range(8) for i in range(30)]
    stream = source(spark, tmp_path / "in", rows, 8)
    path = str(tmp_path / "run")
    held = []
    with retries.timed_state(spark):
        made = retries.retries(stream, keep_ms=6 * HOUR // 1000)
        query = made.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/{n}")).start()
        query.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 8 and max(held) <= 5 * 60 < 5 * len(rows)
    # Of 240 URLs all but the last day's were forgotten.
    assert held[-1] <= 5 * 30
    events = spark.read.parquet(*(f"{path}/{n}" for n in range(len(held)) if os.path.isdir(f"{path}/{n}")))
    assert events.where("event = 'downloaded'").count() == 80 and events.where("event = 'lost'").count() >= 7 * 20


def test_times(spark):
    """Due after 300, 600 and 900 milliseconds; the fourth failure ends the task; an outcome that comes too early is nobody's."""
    task, out = retries.Task(), []
    for at, ok in ((0, False), (299_999, True), (300_000, False), (900_000, False), (1_800_000, False), (1_800_001, True), (1_800_002, False)):
        out += task.outcome(at, ok, 3, 300_000, HOUR)
    assert out == [("retry", 1, 300_000), ("retry", 2, 900_000), ("retry", 3, 1_800_000), ("failed", 4, 1_800_000), ("downloaded", 1, 1_800_001)]
    assert task.wake(HOUR) == 1_800_000 + HOUR and task.upto(HOUR + 1_800_000, HOUR) == [] and task.failed is None and task.downloaded is not None
    assert task.outcome(2 * HOUR, False, 3, 300_000, HOUR) == [] and task.due == 2 * HOUR + 300_000 and task.downloaded is None
