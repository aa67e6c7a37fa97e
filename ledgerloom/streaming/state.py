"""Stateful operators: a coalescing outbox, a watcher."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def coalesce_stream(events: DataFrame) -> DataFrame:
    """user_id, n, first_event_id, last_event_id, route: the pending row of each key after each
    batch; n = 0 once it was delivered. A delivery clears what is pending before it."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState):
        n, first, last, route = state.get if state.exists else (0, None, None, None)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for e in rows.itertuples():
            if e.event_type == "purchase":
                n, first, last, route = 0, None, None, None
            else:
                n, first, last = n + 1, e.event_id if first is None else first, e.event_id
                route = e.value if e.event_type == "click" else route
        state.update((n, first, last, route))
        yield pd.DataFrame([(key[0], n, first, last, route)], columns=["user_id", "n", "first_event_id", "last_event_id", "route"]).astype({"first_event_id": "Int64", "last_event_id": "Int64"})

    schema = "n long, first_event_id long, last_event_id long, route double"
    return events.groupBy("user_id").applyInPandasWithState(step, f"user_id long, {schema}", schema, "update", GroupStateTimeout.NoTimeout)


def watch_stream(events: DataFrame, gap_seconds: int = 6 * 3600) -> DataFrame:
    """user_id, event_id, action: what a watcher does at each poll, from its last poll of that key."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState):
        before, was = state.get if state.exists else (None, None)
        out = []
        for e in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples():
            now = e.ts.value // 1000
            if e.event_type == "purchase":
                action = "final"
            elif before is None:
                action = "first"
            elif now - before >= gap_seconds * 1_000_000:
                action = "reseed"
            else:
                action = "full" if e.event_type != was else "light"
            out.append((key[0], e.event_id, action))
            before, was = now, e.event_type
        state.update((before, was))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "action"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, action string", "before long, was string", "append", GroupStateTimeout.NoTimeout)
