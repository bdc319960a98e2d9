"""Events of a run: one start and one end per item."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "event_id bigint, ts timestamp_ntz, worker int, kind string, database string, file_name string, "
    "file_path string, size_bytes bigint, exit_code int, message string, written_rows bigint, written_bytes bigint"
)


class EventLog:
    """Collects a few small rows per table; rows of tables never come here."""

    def __init__(self, workers: int):
        self._lock = threading.Lock()
        self._free = list(range(max(1, workers), 0, -1))
        self._rows: list[tuple] = []

    def _add(self, worker: int, kind: str, item: tuple, message: str | None = None, written: dict | None = None) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        with self._lock:
            code = 1 if kind == "failed" else None
            counts = (written or {}).get("rows"), (written or {}).get("text_bytes")
            self._rows.append((len(self._rows), now, worker, kind, *item, code, message, *counts))

    @contextmanager
    def item(self, database: str, file_name: str, file_path: str, size_bytes: int):
        """Wraps one item's work; an error becomes a failed event, not a raise.

        What the work puts into the dict it is given (``rows``, ``text_bytes``) is told by the finished event.
        """
        with self._lock:
            worker = self._free.pop()
        item = (database, file_name, file_path, size_bytes)
        self._add(worker, "started", item)
        written: dict[str, int] = {}
        try:
            yield written
            self._add(worker, "finished", item, written=written)
        except Exception as error:  # each item's failure is reported, the run goes on
            self._add(worker, "failed", item, str(error))
        finally:
            with self._lock:
                self._free.append(worker)

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self._rows, SCHEMA)
