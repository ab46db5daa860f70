"""Settings of a project with defaults, checks and a JSON file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class Settings:
    project_name: str = "project"
    root: str = "."
    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=list)
    skip_tests: bool = False
    max_tokens: int = 10_000

    def problems(self) -> list[str]:
        found = []
        if not self.project_name.strip():
            found.append("project_name must not be empty")
        if self.max_tokens <= 0:
            found.append("max_tokens must be positive")
        found += [f"{n} must be a list of strings" for n in ("include", "exclude") if not all(isinstance(x, str) for x in getattr(self, n))]
        return found


def load(path: str) -> Settings:
    """The file's settings over the defaults; unknown names are an error, a missing file isn't."""
    p = Path(path)
    given = json.loads(p.read_text(encoding="utf-8")) if p.exists() else {}
    if unknown := set(given) - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = Settings(**given)
    if found := out.problems():
        raise ValueError("; ".join(found))
    return out


def save(settings: Settings, path: str) -> None:
    Path(path).write_text(json.dumps(asdict(settings), indent=2) + "\n", encoding="utf-8")
