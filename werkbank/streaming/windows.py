"""Counts per period of event time whose state ends, with a table of what came too late."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from werkbank.functions.dates import bucket

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PERIODS = {"day": "1 day", "week": "7 days", "month": "1 month", "year": "1 year"}
COUNTS = "period date, kind string, n long"


def bounded_counts(source: DataFrame, at: str, grain: str, delay: str) -> DataFrame:
    """Rows of ``period``, ``kind`` and ``n``: ``open`` with the count so far of a period that a batch adds to, ``closed`` with
    its last count once the watermark (the latest time seen less ``delay``) has passed its end, and ``late`` with the
    number of a batch's rows of a closed period. A period's last count and its late rows together are all its rows, for any
    delay and order of batches. Rows without a time have the period NULL, which never closes.

    Tasks sum their rows per period before the shuffle. Sums carry no time of their own, so that Spark never drops one as late;
    a row beside them, with the latest time of its part and no count, moves the watermark. The state is one
    number per open period, and its timeout, the end of the period in event time, removes it."""
    length = F.expr(f"interval {PERIODS[grain]}")
    start = bucket(F.col(at), grain)
    rows = source.select(start.alias("period"), F.unix_micros(start.cast("timestamp") + length).alias("until"), F.unix_micros(
        F.col(at).cast("timestamp")).alias("at"))

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = frame.groupby(["period", "until"], dropna=False).size().reset_index(name="n")
            sums["at"] = None
            latest = pd.DataFrame({"period": [None], "until": [None], "n": [0], "at": [frame["at"].max()]})
            yield pd.concat([sums.astype(object), latest.astype(object)]).astype({"until": "Int64", "n": "int64", "at": "Int64"})

    partial = rows.mapInPandas(summed, "period date, until long, n long, at long").withColumn(
        "at", F.timestamp_micros("at")).withWatermark("at", delay)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        period, until = key
        end = None if pd.isna(until) else -(-int(until) // 1000)
        out, mark = [], state.getCurrentWatermarkMs()
        passed = end is not None and mark > 0 and end <= mark
        n = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            out.append((period, "closed", n))
        elif new := sum(int(frame["n"].sum()) for frame in frames):
            if passed:
                # Where the watermark has passed since the last batch, the period ends here, and these rows are late.
                if state.exists:
                    state.remove()
                    out.append((period, "closed", n))
                out.append((period, "late", new))
            else:
                state.update((n + new,))
                if end is not None:
                    state.setTimeoutTimestamp(end)
                out.append((period, "open", n + new))
        if out:
            yield pd.DataFrame(out, columns=["period", "kind", "n"])

    return partial.groupBy("period", "until").applyInPandasWithState(run, COUNTS, "n long", "append", "EventTimeTimeout")
