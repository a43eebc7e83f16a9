"""Notes, decisions and the current task: an append-only log and its Markdown forms."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.functions import text

LOG = "ts timestamp, kind string, text string, status string"
_SECRET = re.compile(r"(?i)(?:password|secret|api[_\-.]?key|access[_\-.]?token|bearer|private[_\-.]?key)\s*[=:]\s*\S{4,}|[0-9a-fA-F]{40,}|[A-Za-z0-9+/]{60,}={0,2}")


class SecretInNote(ValueError):
    """A note that seems to hold a credential is not stored."""


def now() -> str:
    return datetime.now(tz=UTC).isoformat(timespec="seconds")


def accepted_notes(notes: DataFrame) -> DataFrame:
    """Rows of ``notes`` whose text holds no credential."""
    return notes.where(F.col("text").isNotNull() & ~text.holds_secret(F.col("text")))


def rendered(log: DataFrame, kind: str) -> DataFrame:
    """(ts, line): entries of a kind as they are shown, oldest first."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    line = F.concat(F.lit("- **"), stamp, F.lit("** — "), F.col("text"))
    return log.where(F.col("kind") == kind).select("ts", line.alias("line")).orderBy("ts", "line")


class Notebook:
    """The notes of a workspace directory, as Markdown files that people may edit."""

    def __init__(self, root: str | Path):
        self.root = Path(root)
        self.memory, self.decisions, self.task = (self.root / n for n in ("MEMORY.md", "DECISIONS.md", "CURRENT_TASK.md"))

    @staticmethod
    def _checked(note: str) -> str:
        if _SECRET.search(note):
            raise SecretInNote("the note seems to hold a credential")
        return note

    def _started(self, path: Path, head: str) -> str:
        self.root.mkdir(parents=True, exist_ok=True)
        if not path.exists():
            path.write_text(head, encoding="utf-8")
        return path.read_text(encoding="utf-8")

    def add(self, note: str, ts: str | None = None) -> None:
        """Append a note to the section of notes, before the section that follows it."""
        entry = f"- **{ts or now()}** — {self._checked(note)}\n"
        held = self._started(self.memory, "# Project Memory\n\n## Notes\n\n")
        if "## Notes" not in held:
            held += "\n## Notes\n\n"
        start = held.index("## Notes") + len("## Notes")
        following = re.search(r"\n##\s", held[start:])
        if following:
            at = start + following.start()
            held = held[:at] + "\n" + entry + held[at:]
        else:
            held = held.rstrip("\n") + "\n" * (2 if held.rstrip("\n").endswith("## Notes") else 1) + entry
        self.memory.write_text(held, encoding="utf-8")

    def decide(self, text: str, status: str = "accepted", ts: str | None = None) -> None:
        """Append a decision with its status."""
        ts = ts or now()
        held = self._started(self.decisions, "# Decision Log\n\n")
        entry = f"\n---\n\n### [{ts[:10]}] Decision\n\n**Status:** {status}\n\n**Decision:** {self._checked(text)}\n\n**Logged:** {ts}\n"
        self.decisions.write_text(held + entry, encoding="utf-8")

    def listed(self, decisions: bool = True) -> str:
        paths = [self.memory, *([self.decisions] if decisions else [])]
        return "\n".join(p.read_text(encoding="utf-8") for p in paths if p.exists())

    def set_task(self, description: str, status: str = "In progress", ts: str | None = None) -> None:
        self.root.mkdir(parents=True, exist_ok=True)
        body = f"# Current Task\n\n**Status:** {status}  \n**Set:** {ts or now()}\n\n## Task\n\n{description}\n\n## Acceptance Criteria\n\n- [ ] \n\n## Notes\n\n"
        self.task.write_text(body, encoding="utf-8")

    def clear_task(self, ts: str | None = None) -> None:
        if self.task.exists():
            self.set_task("<!-- No active task. -->", "Cleared", ts)

    def shown_task(self) -> str:
        return self.task.read_text(encoding="utf-8") if self.task.exists() else ""
