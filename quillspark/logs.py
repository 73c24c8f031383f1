"""Structured logs: one JSON object a line, bounded lines, files that rotate."""

from __future__ import annotations

import json
import os
import threading
import time

from quillspark.errors import EngineError

# Levels in order, and the bounds of a rotating log.
LEVELS = ("debug", "info", "warning", "error")
LINE_BYTES = 2048
FILE_BYTES, FILES = (2 << 10, 1 << 30), (1, 20)


class Log:
    """Writes events to a file of the driver. When a line would make it larger than ``most_bytes`` the file becomes ``path.1``, that one ``path.2``, and so on; at most ``files`` are kept."""

    def __init__(self, path: str, level: str = "info", most_bytes: int = 1 << 20, files: int = 5, clock=time.time):
        if level not in LEVELS:
            raise EngineError("log.level", f"level must be one of {', '.join(LEVELS)}")
        if not FILE_BYTES[0] <= most_bytes <= FILE_BYTES[1] or not FILES[0] <= files <= FILES[1]:
            raise EngineError("log.limits", "size or number of files out of range")
        self.path, self.level, self.most_bytes, self.files, self.clock = path, LEVELS.index(level), most_bytes, files, clock
        self.lock = threading.Lock()
        self.dropped = 0

    def write(self, level: str, event: str, **values) -> bool:
        """One event; false if its level is below the log's, or its line too long (then it is counted as dropped)."""
        if LEVELS.index(level) < self.level:
            return False
        line = json.dumps({"ts_us": int(self.clock() * 1e6), "level": level, "event": event, **values}, ensure_ascii=False, default=str) + "\n"
        data = line.encode()
        with self.lock:
            if len(data) > LINE_BYTES:
                self.dropped += 1
                return False
            size = os.path.getsize(self.path) if os.path.exists(self.path) else 0
            if size and size + len(data) > self.most_bytes:
                self._rotate()
            with open(self.path, "ab") as f:
                f.write(data)
        return True

    def _rotate(self) -> None:
        for k in range(self.files - 1, 0, -1):
            older = self.path if k == 1 else f"{self.path}.{k - 1}"
            if os.path.exists(older):
                os.replace(older, f"{self.path}.{k}")
        if self.files == 1:
            os.remove(self.path)

    def query(self, kind: str, status: int, micros: int, **values) -> bool:
        """A request's end: errors are warnings."""
        return self.write("info" if status == 0 else "warning", "query", kind=kind, status=status, micros=micros, **values)

    def metrics(self, rows) -> int:
        """An event for each row of a small table of metrics; how many were written."""
        return sum(self.write("info", "metrics", **row.asDict()) for row in rows)
