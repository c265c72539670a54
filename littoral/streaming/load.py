"""Consumers that commit after their work, and analytics that stand back while consumers are behind."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import message_log
from .pipeline import batch_folder


def consume(messages: DataFrame, handle: Callable[[DataFrame], tuple[DataFrame, DataFrame]], path: str, checkpoint: str) -> None:
    """Handles all messages that are there, then stops. ``handle`` gives what came of a batch and the messages it couldn't
    take; both are stored under ``path``, each batch in folders of its own. Offsets are committed after both are written:
    if anything fails before, the batch comes again and replaces what it had left. A bad message never holds up others."""

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good, bad = handle(batch)
        batch_folder(f"{path}/done")(good, number)
        batch_folder(f"{path}/failed")(bad, number)
        batch.unpersist()

    messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class LagListener(StreamingQueryListener):
    """Keeps how many messages each query is behind, from its progress events: of a message log, what was there when the
    batch ended less what the batch took; of other sources, the metrics that they report. Register with
    ``spark.streams.addListener``. Queries that end are no longer counted, unless they failed."""

    def __init__(self) -> None:
        self.behind: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.behind.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.behind[str(progress.id)] = sum(map(self.of_source, progress.sources))

    def onQueryIdle(self, event) -> None:
        self.behind[str(event.id)] = 0

    def onQueryTerminated(self, event) -> None:
        if event.exception is None:
            self.behind.pop(str(event.id), None)

    @staticmethod
    def of_source(source) -> int:
        try:
            end, latest = json.loads(source.endOffset or "{}"), json.loads(source.latestOffset or "{}")
            if isinstance(end, dict) and isinstance(latest, dict) and latest:
                return sum(max(0, int(n) - int(end.get(p, 0))) for p, n in latest.items())
        except (TypeError, ValueError):
            pass
        metrics = source.metrics or {}
        return int(metrics.get("numRowsOutstanding") or metrics.get("maxOffsetsBehindLatest") or 0)

    def total(self) -> int:
        return sum(self.behind.values())


class LoadShedding:
    """Runs analytics only while consumers are at most ``most`` messages behind: those that ``listener`` sees and the
    groups of message logs named by ``watch``. A lag that can't be told counts as none."""

    def __init__(self, most: int = 500, listener: LagListener | None = None, watch: list[tuple[str, str]] = ()) -> None:
        self.most, self.listener, self.watch = most, listener, list(watch)
        self.skipped = 0

    def behind(self) -> int:
        return (self.listener.total() if self.listener else 0) + sum(message_log.lag(path, group) for path, group in self.watch)

    def run(self, job: Callable[[], object]) -> bool:
        """Whether the job ran; a skipped one waits for its next turn."""
        if self.behind() > self.most:
            self.skipped += 1
            return False
        job()
        return True
