"""Transient queues in the driver's memory: one FIFO for each type, and named lists that are replaced whole."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Iterable
from typing import Any

from strandgrid.plans.errors import QueryError

#: Fixed limit: a put that would make a queue hold this many items is refused.
LIMIT = 300


class Queues:
    def __init__(self):
        self._lock = threading.Lock()
        self._queues: dict[str, deque] = {}
        self._named: dict[tuple[str, str], list] = {}

    def put(self, kind: str, item: Any) -> None:
        with self._lock:
            q = self._queues.setdefault(kind, deque())
            if len(q) + 1 >= LIMIT:
                raise QueryError(f"queue {kind} is full")
            q.append(item)

    def get_all(self, kind: str) -> list[Any]:
        """Everything in the queue, oldest first; the queue is empty afterwards."""
        with self._lock:
            return list(self._queues.pop(kind, ()))

    def replace_named(self, kind: str, name: str, items: Iterable[Any]) -> None:
        with self._lock:
            self._named[kind, name] = list(items)

    def get_named(self, kind: str, name: str, delete: bool = False) -> list[Any]:
        with self._lock:
            found = self._named.get((kind, name), [])
            if delete:
                self._named.pop((kind, name), None)
            return list(found)
