"""What the jobs share: their small configuration files and their log."""

from __future__ import annotations

import json
import logging
from pathlib import Path


def settings(job: str, path: str | None = None, **changes) -> dict:
    """The job's own JSON file, what the file at ``path`` changes, and ``changes``; unknown names are an error."""
    found = json.loads((Path(__file__).parent / f"{job}.json").read_text())
    for more in (json.loads(Path(path).read_text()) if path else {}, changes):
        if unknown := set(more) - set(found):
            raise ValueError(f"{job} has no setting {', '.join(sorted(unknown))}")
        found |= more
    return found


def log(job: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{job}")


def log_to_stderr() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
