"""Requests and tokens in a sliding window: what is used, what a limit would have made of it, and a limit as state, where only what it admits and reserves counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Rows that a task decides upon at a time.
PIECE_ROWS = 100_000


def window_usage(calls: DataFrame, time_col: str, tokens: Column, by: list[str], seconds: int = 60) -> DataFrame:
    """calls with requests_used and tokens_used within the last `seconds` seconds up to each, per group: a shard of a limiter."""
    span = seconds * 1_000_000
    at = F.unix_micros(F.col(time_col).cast("timestamp"))
    # groups are cut into buckets as long as the window; a bucket's rows go to the next one too, where they only count
    own = F.floor((at - F.pmod(at, F.lit(span))) / span)
    both = F.when(at.isNull(), F.array(F.struct(own.alias("bucket"), F.lit(True).alias("own")))).otherwise(F.array(F.struct(own.alias("bucket"), F.lit(True).alias("own")), F.struct((own + 1).alias("bucket"), F.lit(False).alias("own"))))
    dealt = calls.select(*calls.columns, F.explode(both).alias("__in"))
    inside = Window.partitionBy(*by, "__in.bucket").orderBy(at).rangeBetween(-span, 0)
    used = dealt.withColumns({"requests_used": F.count(F.lit(1)).over(inside), "tokens_used": F.sum(tokens).over(inside)})
    return used.filter("__in.own").drop("__in")


def admission(calls: DataFrame, time_col: str, tokens: Column, by: list[str], rpm: int, tpm: int, seconds: int = 60) -> DataFrame:
    """window_usage with admitted (neither limit passed, this call included) and delay_seconds, when a call that isn't should come: the window over the token limit times what is used."""
    used = window_usage(calls, time_col, tokens, by, seconds)
    admitted = (F.col("requests_used") <= rpm) & (F.col("tokens_used") <= tpm)
    return used.withColumns({"admitted": admitted, "delay_seconds": F.when(admitted, 0.0).otherwise(F.lit(float(seconds)) * F.col("tokens_used") / tpm)})


class LimitWindow:
    """What counts against a limit: admitted calls of the last `span` microseconds, and reservations until their time. Calls come in order of time, none after `last`, if that is given: reservations beyond it are kept as a number and a sum."""

    def __init__(self, rpm: int, tpm: int, span: int, admitted=(), reserved=(), last: int | None = None) -> None:
        self.rpm, self.tpm, self.span, self.last = rpm, tpm, span, last
        self.admitted, self.reserved, self.beyond = deque(admitted), list(reserved), 0
        heapify(self.reserved)
        self.tokens = sum(c for _, c in self.admitted) + sum(c for _, c in self.reserved)

    def call(self, at: int, cost: int) -> tuple[bool, float]:
        """Whether a call is admitted, and else the seconds until the time that is reserved for it."""
        while self.admitted and self.admitted[0][0] <= at - self.span:
            self.tokens -= self.admitted.popleft()[1]
        while self.reserved and self.reserved[0][0] <= at:
            self.tokens -= heappop(self.reserved)[1]
        if len(self.admitted) + len(self.reserved) + self.beyond < self.rpm and self.tokens + cost <= self.tpm:
            self.admitted.append((at, cost))
            self.tokens += cost
            return True, 0.0
        wait = self.span * (self.tokens + cost) // self.tpm
        if self.last is not None and at + wait > self.last:
            self.beyond += 1
        else:
            heappush(self.reserved, (at + wait, cost))
        self.tokens += cost
        return False, wait / 1e6

    def state(self) -> list[list[int]]:
        return [[x for pair in part for x in pair] for part in (self.admitted, sorted(self.reserved))]


def _pairs(flat) -> list[tuple[int, int]]:
    numbers = [int(x) for x in flat]
    return list(zip(numbers[::2], numbers[1::2], strict=True))


def admission_state(calls: DataFrame, time_col: str, tokens: Column, by: list[str], rpm: int, tpm: int, seconds: int = 60, order: list[str] | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """calls with admitted and delay_seconds, of a limit for each group that keeps state: a call is admitted if the calls admitted within the last `seconds` seconds and the open reservations are fewer than rpm, and their tokens with its own at
    most tpm. One that isn't reserves its tokens until delay_seconds later: the window over the token limit times the tokens in use and its own.

    Calls of equal time are taken in `order`, then as their other columns are ordered. Those without a time count nothing and are null; tokens are not negative, null ones are 0. What a call gets depends on all calls of its group before it, and
    where more is asked for than the limit lets through, reservations pile up and nothing is ever forgotten. So rows move once: Spark sorts each group by time, and they stream through a task, at most piece_rows at a time. The task holds
    the admitted calls of a window (fewer than rpm) and the reservations that end before the group's last call.
    """
    span, names = seconds * 1_000_000, calls.columns
    timed = calls.withColumns({"__t": F.unix_micros(F.col(time_col).cast("timestamp")), "__cost": F.coalesce(tokens.cast("long"), F.lit(0))}).filter("__t is not null")
    # no reservation beyond the last call of all can end
    last = timed.agg(F.max("__t").alias("last")).first()["last"]
    told = StructType([*[calls.schema[c] for c in names], *StructType.fromDDL("admitted boolean, delay_seconds double").fields])
    ties = order or [c for c in names if calls.schema[c].dataType.typeName() not in ("map", "variant")]
    ordered = timed.repartition(*by).sortWithinPartitions(*by, "__t", *ties).withColumn("__key", F.to_json(F.struct(*by)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, window = None, None
        for whole in batches:
            for first in range(0, whole.num_rows, piece_rows):
                batch = whole.slice(first, piece_rows)
                admitted, delays = [], []
                for key, at, cost in zip(*[batch.column(c).to_pylist() for c in ("__key", "__t", "__cost")], strict=True):
                    if key != group:
                        group, window = key, LimitWindow(rpm, tpm, span, last=last)
                    ok, delay = window.call(at, cost)
                    admitted.append(ok)
                    delays.append(delay)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(admitted, pa.bool_()), pa.array(delays, pa.float64())], told.names)

    done = ordered.mapInArrow(run, told)
    untimed = calls.filter(F.col(time_col).isNull())
    return done.unionByName(untimed.withColumns({"admitted": F.lit(None).cast("boolean"), "delay_seconds": F.lit(None).cast("double")}))


def admission_stream(calls: DataFrame, time_col: str, tokens: Column, by: str, ident: str, rpm: int, tpm: int, seconds: int = 60) -> DataFrame:
    """admission_state() of a stream: by, ident, admitted and delay_seconds of each call, with the state of each group in the state store, so that a restart goes on where it was. Calls of a micro-batch are taken in order of time, then of ident; a call that
    comes in a later micro-batch than one after it counts at the time that it has."""
    span = seconds * 1_000_000
    kinds = {c: calls.schema[c].dataType.simpleString() for c in (by, ident)}
    asked = calls.select(by, ident, F.unix_micros(F.col(time_col).cast("timestamp")).alias("__t"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("__cost")).filter("__t is not null")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [])
        window = LimitWindow(rpm, tpm, span, _pairs(held[0]), _pairs(held[1]))
        # a micro-batch's calls of one group: numbers only, and bounded by what the stream admits to a micro-batch
        rows = pd.concat(list(batches)).sort_values(["__t", ident])
        answers = [window.call(t, c) for t, c in zip(rows["__t"].tolist(), rows["__cost"].tolist(), strict=True)]
        state.update(tuple(window.state()))
        yield pd.DataFrame({by: rows[by], ident: rows[ident], "admitted": [a for a, _ in answers], "delay_seconds": [d for _, d in answers]})

    schema = f"{by} {kinds[by]}, {ident} {kinds[ident]}, admitted boolean, delay_seconds double"
    return asked.groupBy(by).applyInPandasWithState(run, schema, "admitted array<long>, reserved array<long>", "append", GroupStateTimeout.NoTimeout)
