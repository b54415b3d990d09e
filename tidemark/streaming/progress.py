"""What streams tell of themselves, as facts: rows and batches read, delays, heartbeats, starts, ends and failures."""

from __future__ import annotations

import threading
from collections import deque
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.facts import ABSOLUTE, AGGREGATE
from ..operators.tiers import Store

SCHEMA = "entity_id string, ts timestamp_ntz, name string, record_type string, value bigint, arrival_seq bigint"
#: Events that wait to be taken, at most; the oldest go first.
WAITING = 100_000


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class ProgressFacts(StreamingQueryListener):
    """Facts of every stream of a session, under the entity `stream-<name>` (its id, where it has no name).

    rows-in, batches, heartbeats (batches and idle ticks), starts, stops and failures add up; batch-ms and delay-ms, how long
    the last batch took and how old its trigger was once it was done, are last values. Register it with spark.streams.addListener.
    """

    def __init__(self) -> None:
        self._facts: deque[tuple] = deque(maxlen=WAITING)
        self._seq, self._lock, self._ended = 0, threading.Lock(), threading.Condition()
        self._done: set[str] = set()
        self._names: dict[str, str] = {}

    def _add(self, run: object, ts: datetime, **values: tuple[str, int]) -> None:
        with self._lock:
            self._seq += 1
            entity = f"stream-{self._names.get(str(run), str(run))}"
            self._facts.extend((entity, ts, n.replace("_", "-"), kind, int(v), self._seq) for n, (kind, v) in values.items())

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name or str(event.id)
        self._add(event.runId, _now(), starts=(AGGREGATE, 1))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        began, now = datetime.fromisoformat(p.timestamp).replace(tzinfo=None), _now()
        took = p.durationMs.get("triggerExecution", 0)
        self._add(
            p.runId, began, rows_in=(AGGREGATE, p.numInputRows), batches=(AGGREGATE, 1), heartbeats=(AGGREGATE, 1),
            batch_ms=(ABSOLUTE, took), delay_ms=(ABSOLUTE, (now - began).total_seconds() * 1000),
        )

    def onQueryIdle(self, event) -> None:
        self._add(event.runId, datetime.fromisoformat(event.timestamp).replace(tzinfo=None), heartbeats=(AGGREGATE, 1))

    def onQueryTerminated(self, event) -> None:
        self._add(event.runId, _now(), stops=(AGGREGATE, 1), **({"failures": (AGGREGATE, 1)} if event.exception else {}))
        with self._ended:
            self._done.add(str(event.runId))
            self._ended.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Wait until the end of a stream has been told; listeners hear of it a little later."""
        with self._ended:
            return self._ended.wait_for(lambda: str(query.runId) in self._done, seconds)

    def take(self, spark: SparkSession) -> DataFrame:
        """The facts so far, which are then no longer kept here."""
        with self._lock:
            rows = [self._facts.popleft() for _ in range(len(self._facts))]
        return spark.createDataFrame(rows, SCHEMA)

    def flush(self, store: Store, batch: int) -> None:
        """Write the facts so far as a batch of a store. Batches are numbered by the caller, as streams' are."""
        store.persist(self.take(store.spark), batch)
