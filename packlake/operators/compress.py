"""Compression of a rendered pack: a protocol, a registry, and providers that need no network."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol


class CompressionProvider(Protocol):
    def compress(self, text: str, *, budget: int) -> str: ...

    def name(self) -> str: ...


class NoOp:
    """The text as it is."""

    def compress(self, text: str, *, budget: int) -> str:
        return text

    def name(self) -> str:
        return "none"


class Squeeze:
    """Drops closing blanks and runs of empty lines, which carry nothing; the budget is not enforced."""

    def compress(self, text: str, *, budget: int) -> str:
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n)", "", text))

    def name(self) -> str:
        return "squeeze"


class Clip:
    """Whole lines from the start, as many as the budget holds at 3.5 characters a token."""

    def compress(self, text: str, *, budget: int) -> str:
        room = int(budget * 3.5)
        return text if len(text) <= room else text[: text.rfind("\n", 0, room) + 1] + "*[clipped]*\n"

    def name(self) -> str:
        return "clip"


PROVIDERS: dict[str, Callable[[], CompressionProvider]] = {"none": NoOp, "squeeze": Squeeze, "clip": Clip}


def provider(name: str) -> CompressionProvider:
    """The provider of a name; an unknown one is an error that lists the choices."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown compressor {name!r}; choose one of: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]()
