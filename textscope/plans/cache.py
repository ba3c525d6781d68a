"""A durable cache of results with an age limit."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from datetime import UTC, datetime, timedelta
from pathlib import Path
from typing import Any


class ResultCache:
    """One JSON file per key in a folder of the driver; writes replace whole files."""

    def __init__(self, folder: str | Path, ttl_days: int = 30, now=lambda: datetime.now(UTC)):
        self.folder, self.ttl, self.now = Path(folder), timedelta(days=ttl_days), now
        self.folder.mkdir(parents=True, exist_ok=True)

    @staticmethod
    def key(name: str, arguments: dict[str, Any]) -> str:
        held = json.dumps({"name": name, "arguments": arguments}, sort_keys=True, ensure_ascii=False, default=str)
        return hashlib.sha256(held.encode()).hexdigest()

    def get(self, key: str) -> Any | None:
        try:
            held = json.loads((self.folder / f"{key}.json").read_text(encoding="utf-8"))
            made = datetime.fromisoformat(held["created_at"])
        except (OSError, ValueError, KeyError):
            return None
        return held["value"] if self.now() - made <= self.ttl else None

    def put(self, key: str, value: Any) -> None:
        f, path = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(f, "w", encoding="utf-8") as out:
            json.dump({"created_at": self.now().isoformat(), "value": value}, out, ensure_ascii=False)
        os.replace(path, self.folder / f"{key}.json")

    def clear(self) -> int:
        found = list(self.folder.glob("*.json"))
        for p in found:
            p.unlink()
        return len(found)
