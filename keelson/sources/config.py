"""Layered configuration: user file, repository file, environment; later ones win."""

from __future__ import annotations

import json
import os
from collections import ChainMap
from pathlib import Path
from typing import Any

from .tree import ScanOptions

NAME, PREFIX = ".keelson.json", "KEELSON_"


def repository_file(start: str) -> Path | None:
    """The nearest file upwards; a folder that holds `.git` is the last one searched."""
    for folder in (p := Path(start).resolve(), *p.parents):
        if (folder / NAME).is_file():
            return folder / NAME
        if (folder / ".git").is_dir():
            return None
    return None


def load(root: str, home: str | None = None, environment: dict[str, str] | None = None) -> ChainMap[str, Any]:
    def read(path: Path | None) -> dict[str, Any]:
        return {k.lower(): v for k, v in json.loads(path.read_text()).items()} if path and path.is_file() else {}

    env = {k[len(PREFIX) :].lower().replace("_", ""): v for k, v in (environment or os.environ).items() if k.startswith(PREFIX)}
    return ChainMap(env, read(repository_file(root)), read(Path(home or Path.home()) / NAME))


def listed(value: Any) -> tuple[str, ...]:
    """Several values: a list, or a text with `|` between them."""
    return tuple(value.split("|")) if isinstance(value, str) else tuple(value or ())


def truth(value: Any) -> bool:
    return value.strip().lower() == "true" if isinstance(value, str) else bool(value)


def scan_options(layers: ChainMap[str, Any], **flags: Any) -> ScanOptions:
    """What a scan goes by: flags that are given, else the layers. Switches are on if any of the two says so; severity is a flag only."""
    either = lambda name, key: bool(flags.get(name)) or truth(layers.get(key, False))
    size = flags.get("max_file_size")
    size = layers.get("maxfilesizebytes") if size is None else size
    return ScanOptions(
        severity=flags.get("severity") or "medium",
        include=listed(flags.get("include") or layers.get("include")) or ("**/*",),
        exclude=listed(flags.get("exclude") or layers.get("exclude")),
        include_generated=either("include_generated", "includegenerated"),
        follow_symlinks=either("follow_symlinks", "followsymlinks"),
        high_entropy=either("include_high_entropy", "includehighentropy"),
        include_pii=either("include_pii", "includepii"),
        max_file_size=5 << 20 if size is None else int(size),
    )
