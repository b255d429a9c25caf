"""Progress of streams, told to a callback at most every so often."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

#: Seconds between two calls about running batches.
THROTTLE = 0.12


class Progress(StreamingQueryListener):
    """Calls ``tell(event, data)`` with started, progress (throttled) and complete.

    Add it with ``spark.streams.addListener(Progress(tell))``.
    """

    def __init__(self, tell: Callable[[str, dict], None], throttle: float = THROTTLE):
        self.tell, self.throttle, self.last = tell, throttle, 0.0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tell("started", {"id": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        now = time.monotonic()
        if now - self.last >= self.throttle:
            self.last = now
            p = event.progress
            self.tell("progress", {"id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell("complete", {"id": str(event.id), "error": event.exception})
