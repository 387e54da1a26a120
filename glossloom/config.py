"""Settings of a translation run. Keys are given to providers apart from them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    provider: str = "mymemory"
    base_url: str = ""
    model: str = ""
    target_lang: str = "zh-CN"
    concurrency: int = 3
    max_mb: int = 8

    def clamped(self) -> Settings:
        """With limits that the services and the driver bear."""
        return replace(self, concurrency=min(max(self.concurrency, 1), 10), max_mb=min(max(self.max_mb, 1), 200))


def load(path: str | Path) -> Settings:
    """Stored settings over the defaults; a missing or broken file and unknown names are passed over."""
    try:
        stored = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return Settings()
    names = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in stored.items() if k in names}).clamped()


def save(settings: Settings, path: str | Path) -> None:
    Path(path).write_text(json.dumps(asdict(settings)))


def export_formats(kinds: set[str]) -> set[str]:
    """Formats that documents of these kinds (text, image, ocr, empty) can be exported to: text files only from pictures,
    PDF only where there is something on the pages."""
    out = {"md", "docx"}
    if kinds & {"image", "ocr"}:
        out.add("txt")
    return out | ({"pdf"} if kinds - {"empty"} else set())
