"""Session-scoped frames with caps and idle expiry."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..errors import EngineError


@dataclass
class Entry:
    frame: DataFrame
    size: int
    used: float


@dataclass
class Workspace:
    """Cached frames by session and name. Sizes are Catalyst's estimates, so a put never counts rows."""

    sessions: int = 100
    frames: int = 50
    frame_bytes: int = 1 << 40
    total_bytes: int = 1 << 42
    idle_seconds: float = 1800
    clock: object = time.monotonic
    _entries: dict[str, dict[str, Entry]] = field(default_factory=dict)

    def put(self, session: str, name: str, df: DataFrame) -> DataFrame:
        if not session:
            raise EngineError("workspace_requires_session", name)
        self.sweep()
        own = self._entries.get(session, {})
        if session not in self._entries and len(self._entries) >= self.sessions:
            raise EngineError("workspace_cap_exceeded", "sessions")
        if name not in own and len(own) >= self.frames:
            raise EngineError("workspace_cap_exceeded", "frames")
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size > self.frame_bytes:
            raise EngineError("workspace_cap_exceeded", "bytes of a frame")
        held = sum(e.size for s in self._entries.values() for e in s.values()) - (own[name].size if name in own else 0)
        if held + size > self.total_bytes:
            raise EngineError("workspace_cap_exceeded", "bytes")
        self.drop(session, name)
        kept = df.cache()
        self._entries.setdefault(session, {})[name] = Entry(kept, size, self.clock())
        kept.createOrReplaceTempView(self.view(session, name))
        return kept

    @staticmethod
    def view(session: str, name: str) -> str:
        safe = "".join(c if c.isalnum() else "_" for c in session)
        return f"{safe}__{name}"

    def get(self, session: str, name: str) -> DataFrame:
        self.sweep()
        entry = self._entries.get(session, {}).get(name)
        if entry is None:
            raise EngineError("workspace_not_found", name)
        entry.used = self.clock()
        return entry.frame

    def drop(self, session: str, name: str) -> bool:
        entry = self._entries.get(session, {}).pop(name, None)
        if entry is None:
            return False
        entry.frame.unpersist()
        entry.frame.sparkSession.catalog.dropTempView(self.view(session, name))
        if not self._entries[session]:
            del self._entries[session]
        return True

    def sweep(self) -> int:
        """Drops what has been idle for too long."""
        late = self.clock() - self.idle_seconds
        old = [(s, n) for s, own in self._entries.items() for n, e in own.items() if e.used < late]
        return sum(self.drop(s, n) for s, n in old)

    def names(self, session: str) -> list[str]:
        return sorted(self._entries.get(session, {}))
