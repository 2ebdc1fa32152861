"""Progress of streaming commits: frames for a callback, and a heartbeat that repeats the last one."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls send with frames (dicts): validating, committing, then result or error; while nothing happens, the last frame again."""

    def __init__(self, send: Callable[[dict], None], every: float = 20.0):
        self.send, self.every = send, every
        self.last: dict | None = None
        self.stop = threading.Event()
        threading.Thread(target=self._beat, daemon=True).start()

    def _frame(self, **frame) -> None:
        self.last = frame
        self.send(frame)

    def _beat(self) -> None:
        while not self.stop.wait(self.every):
            if self.last and self.last["type"] not in ("result", "error"):
                self.send(self.last)

    def onQueryStarted(self, event) -> None:
        self._frame(type="validating", id=str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._frame(type="committing", id=str(p.id), batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.stop.set()
        self._frame(**({"type": "error", "message": event.exception} if event.exception else {"type": "result", "id": str(event.id)}))


def ndjson(frame: dict) -> str:
    return json.dumps(frame) + "\n"
