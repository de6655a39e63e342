"""One JSON object a line: time, run, level, event and its fields."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone
from typing import Any

logger = logging.getLogger("plumbline")


class Log:
    def __init__(self, run_id: str):
        self.run_id = run_id

    def __call__(self, event: str, level: str = "INFO", **fields: Any) -> str:
        line = json.dumps({"ts": datetime.now(timezone.utc).isoformat(), "run_id": self.run_id, "level": level, "event": event, **fields}, default=str, ensure_ascii=False)
        logger.log(getattr(logging, level, logging.INFO), line)
        return line
