"""Durations such as 30m, 2h, 7d."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .reader import ParseError, Reader

# Seconds of a unit.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_SHAPE = re.compile(r"(\d+)\s*([A-Za-z]+)")


@dataclass(frozen=True)
class Duration:
    text: str
    seconds: int

    def __str__(self) -> str:
        return self.text

    @classmethod
    def parse(cls, text: str) -> Duration:
        found = re.fullmatch(r"(\d*)([^\d].*)?", text.strip(), re.S)
        count, unit = (found.group(1), found.group(2)) if found else ("", None)
        if unit is None:
            raise ParseError(f"'{text}' has no unit of time")
        if not count:
            raise ParseError(f"'{text}' is no length of time")
        if unit not in UNITS:
            raise ParseError(f"'{unit}' is no unit of time; these are s, m, h, d, w")
        if int(count) >= 2**64 or int(count) * UNITS[unit] >= 2**64:
            raise ParseError("a length of time beyond what can be counted")
        return cls(f"{int(count)}{unit}", int(count) * UNITS[unit])

    @classmethod
    def read(cls, source: Reader) -> Duration:
        text = source.take(_SHAPE)
        if text is None:
            raise ParseError(f"a length of time such as 30m should stand at {source.next_shown()}")
        return cls.parse("".join(text.split()))
