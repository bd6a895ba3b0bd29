"""Logs a query's start, progress, idling and end."""

import logging
from collections import deque

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)


class ProgressListener(StreamingQueryListener):
    """Keeps the last ``most`` events; all of them are logged."""

    def __init__(self, most=1000):
        self.events = deque(maxlen=most)

    def _note(self, kind, detail):
        self.events.append((kind, detail))
        log.info("stream %s: %s", kind, detail)

    def onQueryStarted(self, event):
        self._note("started", str(event.id))

    def onQueryProgress(self, event):
        progress = event.progress
        self._note(
            "progress",
            {
                "rows": progress.numInputRows,
                "metrics": {k: v.asDict() for k, v in progress.observedMetrics.items()},
            },
        )

    def onQueryIdle(self, event):
        self._note("idle", str(event.id))

    def onQueryTerminated(self, event):
        self._note("ended", event.exception)
