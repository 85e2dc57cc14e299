"""A cache of results on the driver, by request, with a time to live."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

SECONDS = 300.0


def request_key(*parts: str | None) -> str:
    """instance, name, type, section, query, format, page, count: joined by colons, missing ones left out."""
    return ":".join(str(p) for p in parts if p is not None)


class ResultCache:
    def __init__(self, seconds: float = SECONDS, prefix: str = "", clock: Callable[[], float] = time.monotonic):
        self.seconds, self.prefix, self.clock, self._held = seconds, prefix, clock, {}

    def get_or_compute(self, key: str, compute: Callable[[], Any]) -> Any:
        now = self.clock()
        self._held = {k: v for k, v in self._held.items() if v[0] > now}
        if self.prefix + key not in self._held:
            self._held[self.prefix + key] = (now + self.seconds, compute())
        return self._held[self.prefix + key][1]
