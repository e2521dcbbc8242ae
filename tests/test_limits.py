"""Sliding windows against plain Python."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import limits


def test_windows_are_cut_into_buckets_of_time(spark):
    rng = random.Random(1)
    start = datetime.datetime(1969, 12, 31, 23, 50)
    rows = [(i, "a" if i % 4 else "b", start + datetime.timedelta(seconds=rng.randrange(1200)), i % 7) for i in range(600)]
    rows += [(600 + i, "a", None, 1) for i in range(3)]
    made = spark.createDataFrame(rows, "i int, g string, t timestamp_ntz, n int").repartition(5)
    used = limits.window_usage(made, "t", F.col("n"), ["g"])
    got = {r["i"]: (r["requests_used"], r["tokens_used"]) for r in used.collect()}
    for i, g, t, _ in rows:
        inside = [n for _, h, s, n in rows if h == g and (s is None if t is None else s is not None and datetime.timedelta(0) <= t - s <= datetime.timedelta(seconds=60))]
        assert got[i] == (len(inside), sum(inside))
    assert used.count() == len(rows) and used.columns == [*made.columns, "requests_used", "tokens_used"]
    (line,) = [x for x in used._jdf.queryExecution().optimizedPlan().toString().splitlines() if "windowspec" in x.lower()]
    # by the group and the bucket, in the order of time
    assert re.search(r"windowspecdefinition\(g#\w+, \w+#\w+, \w+#\w+ ASC", line)


def plain_admission(rows, rpm, tpm, seconds):
    """rows (ident, group, microseconds, cost) in order -> ident: (admitted, delay), by a loop over all calls of a group."""
    out, held = {}, {}
    for i, g, t, c in rows:
        calls, reserved = held.setdefault(g, ([], []))
        open_ = [x for x in calls if x[0] > t - seconds * 1_000_000] + [x for x in reserved if x[0] > t]
        used = sum(x[1] for x in open_)
        if len(open_) < rpm and used + c <= tpm:
            calls.append((t, c))
            out[i] = (True, 0.0)
        else:
            wait = seconds * 1_000_000 * (used + c) // tpm
            reserved.append((t + wait, c))
            out[i] = (False, wait / 1e6)
    return out


def calls(seed, n, groups=3, horizon=4_000):
    """Calls in bursts: one group has most of them, some come at one time, some cost more than any window has."""
    rng, start = random.Random(seed), datetime.datetime(2020, 1, 1)
    rows = [(i, "abcd"[min(rng.randrange(6), groups - 1)], start + datetime.timedelta(seconds=rng.choice([rng.randrange(horizon), 500 + rng.randrange(60), 777])), rng.choice([0, 1, 5, 20, 101])) for i in range(n)]
    return sorted(rows, key=lambda r: (r[2], r[0]))


def micros(rows):
    return [(i, g, int((t - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000), c) for i, g, t, c in rows]


@pytest.mark.parametrize("piece_rows", [7, 100_000])
def test_admission_as_state(spark, piece_rows):
    rows = calls(3, 500)
    frame = spark.createDataFrame([(*r, "x") for r in rows] + [(1000, "a", None, 3, "x"), (1001, None, rows[0][2], 3, "x")], "i int, g string, t timestamp_ntz, n int, admitted string").drop("admitted").repartition(5)
    done = limits.admission_state(frame, "t", F.col("n"), ["g"], 5, 100, 60, ["i"], piece_rows)
    got = {r["i"]: (r["admitted"], r["delay_seconds"]) for r in done.collect()}
    assert got.pop(1000) == (None, None) and got.pop(1001) == (True, 0.0)
    assert got == plain_admission(micros(rows), 5, 100, 60) and {a for a, _ in got.values()} == {True, False}
    assert done.columns == ["i", "g", "t", "n", "admitted", "delay_seconds"]
    assert limits.admission_state(frame.limit(0), "t", F.col("n"), ["g"], 5, 100).count() == 0


def test_admission_as_a_stream_that_restarts(spark, tmp_path):
    """Batch by batch, with a restart between, as a loop over all calls in order."""
    rows, source = calls(5, 240), tmp_path / "in"
    schema = "i int, g string, t timestamp_ntz, n int"
    for part in range(4):
        spark.createDataFrame(rows[60 * part : 60 * part + 60], schema).coalesce(1).write.mode("append").parquet(str(source))
        for _ in range(2):  # the second start finds nothing new
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
            told = limits.admission_stream(stream, "t", F.col("n"), "g", "i", 5, 100, 60)
            told.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r["i"]: (r["admitted"], r["delay_seconds"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plain_admission(micros(rows), 5, 100, 60)


def test_admission_moves_each_row_once(spark):
    """Where more is asked for than goes through, what a call gets depends on all before it; rows move by group once all the same, and reservations that never end in the data aren't kept one by one."""
    rows = [(i, "ab"[i % 2], datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=i // 3), 50) for i in range(4_000)]
    done = limits.admission_state(spark.createDataFrame(rows, "i int, g string, t timestamp_ntz, n int").repartition(5), "t", F.col("n"), ["g"], 5, 100, 60, ["i"], 50)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {r["i"]: (r["admitted"], r["delay_seconds"]) for r in done.collect()}
    assert got == plain_admission(micros(rows), 5, 100, 60)
    window = limits.LimitWindow(5, 100, 60_000_000, last=1_333_000_000)
    for k in range(4_000):
        window.call(k // 3 * 1_000_000, 50)
    assert window.beyond > 3_800 and len(window.reserved) < 100
