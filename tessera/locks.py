"""Table locks of sessions: shared and exclusive, first come first served; whoever would close a circle of waits gives up."""

from __future__ import annotations

import threading
import time

from .errors import DeadlockVictim, LockTimeout


class Locks:
    def __init__(self, timeout: float = 30.0) -> None:
        self.timeout = timeout
        self._changed = threading.Condition()
        self._held: dict[str, dict[object, str]] = {}
        self._queue: dict[str, list[tuple[object, str]]] = {}

    def acquire(self, owner: object, table: str, mode: str) -> None:
        """mode: S or X. An S lock is raised to X if nobody else holds the table."""
        with self._changed:
            held = self._held.setdefault(table, {})
            if held.get(owner) in (mode, "X"):
                return
            me = (owner, mode)
            self._queue.setdefault(table, []).append(me)
            end = time.monotonic() + self.timeout
            try:
                while self._blockers(owner, table, mode):
                    if self._circle(owner):
                        raise DeadlockVictim(f"waiting for {table} would never end")
                    if not self._changed.wait(max(0.0, end - time.monotonic())) and time.monotonic() >= end:
                        raise LockTimeout(f"{table} stayed locked for {self.timeout} s")
                held[owner] = mode
            finally:
                self._queue[table].remove(me)
                self._changed.notify_all()

    def release(self, owner: object) -> None:
        with self._changed:
            for held in self._held.values():
                held.pop(owner, None)
            self._changed.notify_all()

    def _blockers(self, owner: object, table: str, mode: str) -> set:
        """Holders in the way, and those who came first and would be."""
        held = self._held.get(table, {})
        out = {o for o, m in held.items() if o is not owner and "X" in (m, mode)}
        if owner not in held:
            for o, m in self._queue.get(table, []):
                if o is owner:
                    break
                if "X" in (m, mode):
                    out.add(o)
        return out

    def _circle(self, start: object) -> bool:
        seen, stack = set(), [start]
        while stack:
            owner = stack.pop()
            for table, queue in self._queue.items():
                for o, mode in queue:
                    if o is owner:
                        for b in self._blockers(o, table, mode):
                            if b is start:
                                return True
                            if b not in seen:
                                seen.add(b)
                                stack.append(b)
        return False
