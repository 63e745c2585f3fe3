"""Imports of repositories as jobs: states, progress, and one run at a time for each repository.

A job is a note in the store, so that whoever asks sees the same state.  Streams that keep an index
current report through a listener.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from codelore.sources.store import Store

STATES = ("cloning", "building_graph", "indexing_code", "ready", "error")
NEXT = {None: ("cloning",), "cloning": ("building_graph", "error"), "building_graph": ("indexing_code", "error"), "indexing_code": ("ready", "error"), "ready": ("cloning",), "error": ("cloning",)}
ENDED = (None, "ready", "error")


class Jobs:
    """The import jobs of a store."""

    def __init__(self, store: Store, clock: Callable[[], float] = time.time):
        self.store, self.clock = store, clock

    def get(self, repository: str) -> dict:
        """The job of a repository; empty if there was none."""
        return self.store.get_meta(repository, "job")

    def _set(self, repository: str, **job) -> dict:
        job = self.get(repository) | job | {"repository": repository, "at": self.clock()}
        self.store.set_meta(repository, "job", job)
        return job

    def start(self, repository: str) -> dict:
        """A new job, which is cloning; an error while one is running."""
        state = self.get(repository).get("state")
        if state not in ENDED:
            raise RuntimeError(f"{repository} is being imported: {state}")
        return self._set(repository, state="cloning", done=0, total=0, error="")

    def advance(self, repository: str, state: str, **counts) -> dict:
        """The next state, or the same one with other counts."""
        now = self.get(repository).get("state")
        if state != now and state not in NEXT.get(now, ()):
            raise ValueError(f"no step from {now} to {state}")
        return self._set(repository, state=state, **counts)

    def progress(self, repository: str) -> Callable[[int, int], None]:
        """A callback that notes how far the current state is."""
        return lambda done, total: self._set(repository, done=done, total=total)

    def run(self, repository: str, *steps: tuple[str, Callable[[], object]]) -> dict:
        """Run the steps (state, function) one after another, and end as ready or with the error.

        A step that fails ends the job; what earlier steps wrote stays usable.
        """
        self.start(repository)
        for state, step in steps:
            if state != self.get(repository)["state"]:
                self.advance(repository, state)
            try:
                step()
            except Exception as error:  # the job's state says so
                return self.advance(repository, "error", error=f"{type(error).__name__}: {error}"[:500])
        return self.advance(repository, "ready")


class Progress(StreamingQueryListener):
    """Tells a callback (rows, batch) of every micro-batch, and of a query's failure."""

    def __init__(self, told: Callable[[dict], None]):
        self.told = told

    def onQueryStarted(self, event) -> None:
        self.told({"state": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        self.told({"state": "running", "id": str(event.progress.id), "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:
        self.told({"state": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.told({"state": "error" if event.exception else "ended", "id": str(event.id)})


def listen(spark: SparkSession, told: Callable[[dict], None]) -> Progress:
    listener = Progress(told)
    spark.streams.addListener(listener)
    return listener
