"""The dispatcher replayed: banded queue, routing, bounded job queues, backpressure.

A trace of four kinds of operation drives one dispatcher: ``ENQ`` submits a notification,
``DEQ`` is a turn of the dispatch loop, ``TAKE`` a worker of a channel taking its next job,
``CLOSE`` the end of intake.  A turn takes the oldest notification of the best band and hands
it to its channel's job queue; where that is full, it goes to the back of its band.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tracemill.functions.fold import sorted_fold

OUTPUTS = "outcome string, moved string, depth long"


class Dispatcher:
    """State of one dispatcher: at most the sizes of its bands and job queues."""

    def __init__(self, bands: Sequence[int], pools: Mapping[str, int]):
        self.sizes, self.pools = tuple(bands), dict(pools)
        self.bands = [deque() for _ in self.sizes]
        self.jobs = {c: deque() for c in self.pools}
        self.closed = False

    def _enqueue(self, band: int, item: tuple[str, str]) -> str:
        if self.closed:
            return "shutting_down"
        if len(self.bands[band]) >= self.sizes[band]:
            return "queue_full"
        self.bands[band].append(item)
        return "queued"

    def _turn(self) -> tuple[str, str | None]:
        band = next((i for i, waiting in enumerate(self.bands) if waiting), None)
        if band is None:
            return "empty", None
        item = self.bands[band].popleft()
        name, channel = item
        if channel not in self.pools:
            return "no_pool", name
        if len(self.jobs[channel]) < self.pools[channel]:
            self.jobs[channel].append(name)
            return "submitted", name
        return ("requeued" if self._enqueue(band, item) == "queued" else "dropped"), name

    def step(self, op: str, name: str, band: int, channel: str):
        moved = None
        if op == "ENQ":
            outcome = self._enqueue(band, (name, channel))
        elif op == "DEQ":
            outcome, moved = self._turn()
        elif op == "TAKE":
            waiting = self.jobs.get(channel)
            outcome, moved = ("taken", waiting.popleft()) if waiting else ("idle", None)
        elif op == "CLOSE":
            self.closed, outcome = True, "closed"
        else:
            outcome = "unknown_op"
        return outcome, moved, sum(map(len, self.bands))


def replay(ops: DataFrame, bands: Sequence[int], pools: Mapping[str, int], queue: str = "queue") -> DataFrame:
    """``ops`` (``queue, t, seq, op, id, band, channel``) with ``outcome``, the id ``moved`` and
    the ``depth`` of the bands after it.  There is one ordered stream a dispatcher."""
    sizes, jobs = tuple(bands), dict(pools)
    return sorted_fold(ops, [queue], ["t", "seq"], ["op", "id", "band", "channel"], lambda *_: Dispatcher(sizes, jobs), OUTPUTS)
