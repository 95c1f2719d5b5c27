"""Golden files: results as canonical JSON, compared with what is stored or stored anew."""

from __future__ import annotations

import json
from pathlib import Path


def canonical(value: object) -> str:
    """JSON with sorted keys and two blanks of indentation, a line feed at its end."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def check(path: str, value: object, update: bool = False) -> None:
    """Compare with the file, or write it with ``update``; a missing or different file is an error that says which."""
    file, text = Path(path), canonical(value)
    if update:
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
        return
    if not file.exists():
        raise AssertionError(f"golden file {path} is missing; run with update")
    stored = file.read_text()
    if stored != text:
        line = next((i for i, (a, b) in enumerate(zip(stored.split("\n"), text.split("\n")), 1) if a != b), 0)
        raise AssertionError(f"golden file {path} differs from line {line}")
