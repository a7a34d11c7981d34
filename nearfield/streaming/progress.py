"""Progress of streams: what each batch did, to a log and to whoever asks."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

LOG = logging.getLogger(__name__)


class Progress(StreamingQueryListener):
    """Logs batch, rows and milliseconds of every batch, and calls told(name, batch, rows, milliseconds, metrics), metrics being the observed ones by name."""

    def __init__(self, told: Callable[[str | None, int, int, float, dict], None] | None = None):
        self.told = told

    def onQueryStarted(self, event) -> None:
        LOG.info("stream %s started", event.name or event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = float(p.durationMs.get("triggerExecution", 0))
        LOG.info("stream %s: batch %d, %d rows, %.0f ms", p.name or p.id, p.batchId, p.numInputRows, took)
        if self.told:
            self.told(p.name, p.batchId, p.numInputRows, took, {k: v.asDict() for k, v in p.observedMetrics.items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        LOG.info("stream %s ended%s", event.id, f": {event.exception}" if event.exception else "")


def listen(spark: SparkSession, told: Callable[[str | None, int, int, float, dict], None] | None = None) -> Progress:
    """Adds a listener; `spark.streams.removeListener` takes it away."""
    out = Progress(told)
    spark.streams.addListener(out)
    return out
