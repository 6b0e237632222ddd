"""Requests that are under way: keyed state with time-outs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "started long, at long, status string, updates long"


def lifecycles(
    updates: DataFrame, key: str, at: str, status: str, order: list[str] | None = None, initial: tuple[str, ...] = ("pending",), terminal: tuple[str, ...] = ("completed", "failed"),
    silence: str = "1 hour", delay: str = "10 minutes",
) -> DataFrame:
    """(key, event, status, started, at, updates): what becomes of each request.

    A request begins with an ``initial`` status; updates of a key that has no request under
    way are ignored.  After each batch a request that changed is ``active``; one with a
    ``terminal`` status has that as its event and its state is dropped; one that was silent
    for ``silence`` beyond the watermark is ``expired`` and dropped too.  So the state holds
    the requests under way and nothing else.  Updates of a batch are taken in the order of
    ``at`` and of ``order``.
    """
    ties = order or []
    quiet = int(pd.Timedelta(silence).total_seconds() * 1000)
    rows = updates.select(F.col(key).alias("key"), F.col(at).alias("ts"), F.unix_micros(at).alias("us"), F.col(status).alias("status"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(ties)])
    kind = rows.schema["key"].dataType.simpleString()

    def advance(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            started, last, status_, n = state.get
            out.append((k[0], "expired", status_, started, last, n))
            state.remove()
        else:
            new = pd.concat(list(batches)).sort_values(["us", *[f"o{i}" for i in range(len(ties))]], kind="stable")
            now = tuple(state.get) if state.exists else None
            for us, s in zip(new["us"].tolist(), new["status"].tolist()):
                if now is None:
                    if s not in initial:
                        continue
                    now = (us, us, s, 0)
                now = (now[0], us, s, now[3] + 1)
                if s in terminal:
                    out.append((k[0], s, s, now[0], us, now[3]))
                    now = None
            if now is None:
                if state.exists:
                    state.remove()
            else:
                out.append((k[0], "active", now[2], now[0], now[1], now[3]))
                state.update(now)
                state.setTimeoutTimestamp(max(now[1] // 1000, state.getCurrentWatermarkMs()) + quiet)
        yield pd.DataFrame(out, columns=["key", "event", "status", "started", "at", "updates"])

    grouped = rows.withWatermark("ts", delay).groupBy("key")
    told = grouped.applyInPandasWithState(advance, f"key {kind}, event string, status string, started long, at long, updates long", STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return told.select(F.col("key").alias(key), "event", "status", F.timestamp_micros("started").alias("started"), F.timestamp_micros("at").alias("at"), "updates")
