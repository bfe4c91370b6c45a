"""Subject patterns: dotted tokens, ``*`` for one token, a last ``**`` for one or more."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .reader import ParseError, Reader

TOKEN = re.compile(r"[A-Za-z0-9_-]+")
_PART = re.compile(r"\*\*|\*|[A-Za-z0-9_-]+")
_DOT = re.compile(r"\s*\.\s*")


@dataclass(frozen=True)
class Pattern:
    parts: tuple[str, ...]

    def __str__(self) -> str:
        return ".".join(self.parts)

    @classmethod
    def of(cls, parts: list[str], text: str) -> Pattern:
        if not parts:
            raise ParseError("empty subject pattern")
        for k, part in enumerate(parts):
            if part == "**" and k < len(parts) - 1:
                raise ParseError(f"'**' may only stand at the end of a pattern: '{text}'")
            if not _PART.fullmatch(part):
                raise ParseError(f"invalid token '{part}' in subject pattern '{text}'")
        return cls(tuple(parts))

    @classmethod
    def parse(cls, text: str) -> Pattern:
        return cls.of(text.split("."), text)

    @classmethod
    def read(cls, source: Reader) -> Pattern:
        parts = []
        while True:
            part = source.take(_PART)
            if part is None:
                raise ParseError(f"a part of a subject should stand at {source.next_shown()}")
            parts.append(part)
            if source.take_here(_DOT) is None:
                return cls.of(parts, ".".join(parts))

    @property
    def concrete(self) -> bool:
        return "*" not in self.parts and "**" not in self.parts

    @property
    def tail(self) -> bool:
        """Whether it ends in ``**``."""
        return self.parts[-1] == "**"

    def matches(self, subject: str) -> bool:
        tokens, fixed = subject.split("."), self.parts[: len(self.parts) - self.tail]
        if len(tokens) <= len(fixed) if self.tail else len(tokens) != len(fixed):
            return False
        return all(p in ("*", t) for p, t in zip(fixed, tokens))  # noqa: B905 - a tail is longer
