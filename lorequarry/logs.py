"""Log records as one JSON object a line."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        when = datetime.fromtimestamp(record.created, UTC).isoformat()
        said = {"ts": when, "level": record.levelname, "logger": record.name, "msg": record.getMessage()}
        failure = record.exc_info[1] if record.exc_info else None
        return json.dumps(said | ({"error": str(failure)} if failure else {}), ensure_ascii=False, default=str)


def log_json(level: str = "INFO", logger: str = "lorequarry") -> logging.Handler:
    """Sends the records of a logger to standard error as JSON lines; gives the handler, so that it can be removed."""
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines())
    logging.getLogger(logger).addHandler(handler)
    logging.getLogger(logger).setLevel(level.upper())
    return handler
