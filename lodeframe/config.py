"""Folders and settings from environment variables, with defaults below a project folder."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Paths:
    """Where a project's files are. Values may be any URI that Spark can read."""

    news_data_dir: str = "src/news"
    news_clean_dir: str = "src/news_processed"
    labels_dir: str = "src/labels"
    models_dir: str = "models"
    max_retries: int = 3


def paths(root: str = ".", env: Mapping[str, str] | None = None) -> Paths:
    """Each field from the variable of its name in capitals; else its default below root."""
    env = os.environ if env is None else env
    values: dict[str, str | int] = {}
    for f in fields(Paths):
        given = env.get(f.name.upper())
        if isinstance(f.default, int):
            values[f.name] = int(given) if given else f.default
        else:
            values[f.name] = given.rstrip("/") if given else f"{root.rstrip('/')}/{f.default}"
    return Paths(**values)
