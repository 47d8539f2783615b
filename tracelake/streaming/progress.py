"""Progress of streaming queries as plain numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls `tell(event, name, rows)` when a query starts, has done a batch, or ends. Register with spark.streams.addListener."""

    def __init__(self, tell: Callable[[str, str, int], None]):
        self.tell, self.names = tell, {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self.tell("start", self.names[str(event.id)], 0)

    def onQueryProgress(self, event) -> None:
        self.tell("batch", self.names.get(str(event.progress.id), ""), int(event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell("end", self.names.get(str(event.id), ""), 0)
