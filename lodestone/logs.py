"""Logs as JSON lines."""

from __future__ import annotations

import functools
import json
import logging
import time

LOGGER = logging.getLogger("lodestone")


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"timestamp": record.created, "level": record.levelname, "message": record.getMessage(), **getattr(record, "fields", {})})


def log_init(target, level: str = "INFO") -> None:
    """target: a path or a file-like object."""
    handler = logging.FileHandler(target) if isinstance(target, str) else logging.StreamHandler(target)
    handler.setFormatter(JsonLines())
    LOGGER.handlers[:] = [handler]
    LOGGER.setLevel(level)


def log_time(f):
    """Logs how long each call took, at debug level."""

    @functools.wraps(f)
    def timed(*a, **b):
        began = time.time()
        try:
            return f(*a, **b)
        finally:
            LOGGER.debug("time", extra={"fields": {"time": time.time() - began, "function": f.__name__}})

    return timed
