"""Settings of a run: a file, then the environment, then arguments; the last that names a value wins."""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Where a run reads and writes, and its sizes."""

    source: str = ""
    target: str = ""
    max_words: int = 400
    overlap_words: int = 50
    batch: int = 64

    @classmethod
    def loaded(cls, path: str | None = None, environment: Mapping[str, str] | None = None, arguments: Mapping[str, object] | None = None, prefix: str = "TEXTLOOM_") -> Settings:
        """Defaults, overridden by a JSON file, then ``prefix`` variables, then ``arguments``; a name that is no setting is an error."""
        kinds = {f.name: type(getattr(cls(), f.name)) for f in fields(cls)}
        out = cls()
        found: list[tuple[str, Mapping[str, object]]] = []
        if path:
            try:
                data = json.loads(Path(path).read_text())
            except ValueError as e:
                raise ValueError(f"settings: not JSON: {e}") from e
            found.append((path, data))
        if environment is not None:
            found.append(("environment", {k[len(prefix):].lower(): v for k, v in environment.items() if k.startswith(prefix) and k[len(prefix):].lower() in kinds}))
        found.append(("arguments", {k: v for k, v in (arguments or {}).items() if v is not None}))
        for place, values in found:
            for name, value in values.items():
                if name not in kinds:
                    raise ValueError(f"settings: {place} names {name}, which is none")
                try:
                    out = replace(out, **{name: kinds[name](value)})
                except (TypeError, ValueError) as e:
                    raise ValueError(f"settings: {name} in {place}: {e}") from e
        return out


def run_arguments(argv: list[str]) -> tuple[int, int, str | None]:
    """(run, step, settings file) of a launch; the two numbers are required, and anything else ends it at once."""
    parser = argparse.ArgumentParser(prog="textloom")
    parser.add_argument("run_id", type=int)
    parser.add_argument("step_run_id", type=int)
    parser.add_argument("settings", nargs="?")
    found = parser.parse_args(argv)
    return found.run_id, found.step_run_id, found.settings
