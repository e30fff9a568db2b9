"""Structured logs and stage timings."""

from __future__ import annotations

import json
import logging
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("quern")


class JsonLines(logging.Formatter):
    """One JSON object a record; what is given as ``extra={"fields": {...}}`` stands beside the message."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created)), "level": record.levelname.lower(), "event": record.getMessage(), **getattr(record, "fields", {})}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str)


def to_stderr(level: int = logging.INFO) -> None:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines())
    log.handlers[:] = [handler]
    log.setLevel(level)


@contextmanager
def timed(timings: list[dict], stage: str) -> Iterator[None]:
    """Appends ``{stage, ms}`` when the block ends, by an error too."""
    began = time.perf_counter()
    try:
        yield
    finally:
        timings.append({"stage": stage, "ms": round((time.perf_counter() - began) * 1000, 1)})
