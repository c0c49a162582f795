"""Streams that wait for late events, against batch and against a plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from quillsift.operators import trace
from quillsift.streaming import twins

DAY, END = 1_700_000_000_000, 1_700_900_000_000


def streamed(spark, tmp_path, name, rows, made, late=60_000):
    """Rows (key, id, ms, kind) in four files, each out of order, and a last event far ahead that lets all others go."""
    rng = random.Random(7)
    rows = sorted(rows, key=lambda r: r[2] + rng.randrange(late // 2))  # so each comes within the bound
    size = max(1, len(rows) // 4)
    path = str(tmp_path / name)
    schema = "key long, id long, ms long, kind string"
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    for ms in (END, END + 10 * late):
        spark.createDataFrame([(-1, None, ms, rows[0][3])], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = made(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return sorted(tuple(r) for r in spark.table(name).collect() if r[0] >= 0)


def test_correlation_stream_equals_batch(spark, tmp_path):
    rng, timeout = random.Random(2), 20_000
    rows = []
    for key in range(4):
        for i in range(60):
            at = DAY + i * 3000
            rows.append((key, 1000 * key + i, at, "request"))
            if rng.random() < 0.3:
                rows.append((key, 1000 * key + i, at - rng.randrange(1, 9000), "reply"))  # a stray one, too early
            if rng.random() < 0.7:
                rows.append((key, 1000 * key + i, at + rng.randrange(0, 30_000), "reply"))
        rows += [(key, None, DAY + rng.randrange(180_000), "failure") for _ in range(3)]
    got = streamed(spark, tmp_path, "correlated", rows, lambda e: twins.correlate(e, "key", timeout, "60 seconds"))
    frame = spark.createDataFrame([r for r in rows], "key long, id long, ms long, kind string").withColumn("at", F.col("ms") * 1000)
    of = lambda kind, *cols: frame.filter(F.col("kind") == kind).select(*cols, "at")
    batch = trace.correlate(of("request", "key", "id"), of("reply", "id"), of("failure", "key"), "key", timeout * 1000)
    want = sorted((r.key, r.id, r.status, None if r.took is None else r.took // 1000) for r in batch.collect())
    assert got == want and len({r[2] for r in got}) == 3


def replayed(rows):
    """Commands and ends of one key, in order of time, ends first."""
    out, run, waits, told = [], None, None, False
    for _, i, ms, kind in sorted(rows, key=lambda r: (r[2], r[3] != "end", r[1] is not None, r[1] or 0)):
        if kind == "end":
            if run is not None:
                out.append((run, "ended", ms))
                run, waits, told = waits, None, False
                if run is not None:
                    out.append((run, "started", ms))
        elif i is not None and run is None:
            run = i
            out.append((i, "started", ms))
        elif i is not None:
            if waits is not None:
                out.append((waits, "dropped", ms))
            waits = i
            if not told:
                out.append((run, "stopped", ms))
                told = True
    return out


def test_newest_command_waits_alone(spark, tmp_path):
    rng = random.Random(4)
    rows = [(key, None if kind == "end" or rng.random() < 0.05 else 100 * key + i, DAY + 1000 * i + rng.randrange(3000), kind) for key in range(5) for i in range(40) for kind in [rng.choice(["command", "command", "end"])]]
    got = streamed(spark, tmp_path, "preempted", rows, lambda e: twins.preempt(e, "key", "60 seconds"))
    want = sorted((key, *r) for key in range(5) for r in replayed([r for r in rows if r[0] == key]))
    assert got == want and {r[2] for r in got} == {"started", "stopped", "dropped", "ended"}


@pytest.mark.parametrize("at", [-1, 0, 1])
def test_replies_at_the_edges(spark, at):
    """A reply as early as its request answers it; one before it, or at the end of the time, doesn't."""
    q = spark.createDataFrame([(1, 7, 100)], "key long, id long, at long")
    r = spark.createDataFrame([(7, 100 + at), (7, 100 + at)], "id long, at long")
    none = spark.createDataFrame([], "key long, at long")
    assert [x.status for x in trace.correlate(q, r, none, "key", 1).collect()] == ["answered" if at == 0 else "timed out"]
