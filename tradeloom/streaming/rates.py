"""Rates for requests, both as streams: each request gets the last rate fetched at or before its time.

The batch twin is joins.rate_as_of(). Time is cut into spans of the greatest age that a rate may have, and a rate is in
two of them, its own and the next; so state is keyed by currency and span, a busy currency is many keys, and a span's state
goes when the watermark has passed its end. A request waits until the watermark has passed it: rates that come late but
within the delay count.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

_TIMES = T.StructField("at", T.ArrayType(T.LongType()))
_RATES = T.StructType([_TIMES, T.StructField("rate", T.ArrayType(T.DoubleType()))])
_REQUESTS = T.StructType([_TIMES, T.StructField("id", T.ArrayType(T.StringType()))])
ANSWER = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("currency", T.StringType()), T.StructField("rate", T.DoubleType())])


def _rows(state: ListState) -> Iterator[tuple]:
    """Rows of a list whose values are columns."""
    for columns in state.get():
        yield from zip(*columns, strict=True)


class RateProcessor(StatefulProcessor):
    """One currency and span. Times are microseconds; timers are milliseconds.

    What comes goes to lists of columns, all of a batch in one call: a call for each row took most of the time. A key has
    a timer for its earliest request, not for each, and when it goes off all requests from before the watermark are
    answered together.
    """

    def __init__(self, max_age_seconds: int):
        self._age = max_age_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rates = handle.getListState("rates", _RATES)
        self._waiting = handle.getListState("waiting", _REQUESTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = None
        for some in rows:
            is_rate = (some["kind"] == "rate").to_numpy()
            told, asked = some[is_rate], some[~is_rate]
            if len(told):
                self._rates.appendValue((told["at"].tolist(), told["rate"].tolist()))
            if len(asked):
                at = asked["at"].tolist()
                self._waiting.appendValue((at, asked["id"].tolist()))
                earliest = min(at) if earliest is None else min(earliest, *at)
        if earliest is not None:
            self._handle.registerTimer(earliest // 1000)
        self._handle.registerTimer((key[1] + 1) * self._age // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = set(_rows(self._waiting))  # one that was delivered twice is one
        due = sorted(w for w in waiting if w[0] < now)
        out = []
        if due:
            rates = sorted(dict(_rows(self._rates)).items())  # of two at one time the later delivery
            times = [t for t, _ in rates]
            for at, name in due:
                i = bisect_right(times, at) - 1
                # ages are told by whole seconds, as in the batch job
                fresh = i >= 0 and (at // 1_000_000 - times[i] // 1_000_000) * 1_000_000 < self._age
                out.append((name, key[0], rates[i][1] if fresh else None))
            later = sorted(waiting.difference(due))
            if later:
                self._waiting.put([([at for at, _ in later], [name for _, name in later])])
                self._handle.registerTimer(later[0][0] // 1000)
            else:
                self._waiting.clear()
        if now >= (key[1] + 1) * self._age:  # nothing of this span can come any more
            self._rates.clear()
        if out:
            yield pd.DataFrame(out, columns=ANSWER.names).astype({"rate": "float64"})

    def close(self) -> None:
        pass


def running_rates(requests: DataFrame, rates: DataFrame, max_age_seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """(request_id, currency, rate) of each request once its time is behind the watermark; rate is NULL if none is fresh.

    requests: request_id, currency, ts. rates: currency, rate_per_usdt, fetched_at. Of two rates of one currency and time
    the later delivery counts. The watermark follows the slower of the two streams. What comes from behind it is dropped
    and counted by the query's progress, rows without a currency or time are ignored. Needs the RocksDB state store.
    """
    asked = requests.where("currency is not null and ts is not null").select("currency", F.lit("request").alias("kind"), F.col("request_id").alias("id"), "ts", F.lit(0.0).alias("rate"))
    told = rates.where("currency is not null and fetched_at is not null").select("currency", F.lit("rate").alias("kind"), F.lit("").alias("id"), F.col("fetched_at").alias("ts"), F.col("rate_per_usdt").alias("rate"))
    span = F.floor(F.unix_timestamp("ts") / max_age_seconds)
    both = asked.withWatermark("ts", delay).union(told.withWatermark("ts", delay)).withColumn("at", F.unix_micros("ts"))
    both = both.withColumn("span", F.explode(F.when(F.col("kind") == "rate", F.array(span, span + 1)).otherwise(F.array(span))))
    return both.groupBy("currency", "span").transformWithStateInPandas(statefulProcessor=RateProcessor(max_age_seconds), outputStructType=ANSWER, outputMode="Append", timeMode="EventTime")
