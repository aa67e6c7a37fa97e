"""Heartbeats of running streams: the last progress of each, by listener."""

from __future__ import annotations

import json
import time

from pyspark.sql.streaming import StreamingQueryListener


class Heartbeat(StreamingQueryListener):
    """Keeps name -> (time, batch, rows) and, given a path, writes it as JSON at each progress."""

    def __init__(self, path: str | None = None):
        self.path, self.seen = path, {}

    def _beat(self, key: str, batch: int | None, rows: int | None, state: str) -> None:
        self.seen[key] = {"at": time.time(), "batch": batch, "rows": rows, "state": state}
        if self.path:
            with open(self.path, "w") as f:
                json.dump(self.seen, f)

    def onQueryStarted(self, event) -> None:
        self._beat(str(event.id), None, None, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._beat(str(p.id), p.batchId, p.numInputRows, "running")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._beat(str(event.id), None, None, "failed" if event.exception else "ended")

    def dead(self, as_of: float, after: float = 180) -> list[str]:
        """Streams without a heartbeat for `after` seconds."""
        return sorted(k for k, v in self.seen.items() if v["state"] in ("started", "running") and as_of - v["at"] > after)
