"""Settings of a library, loaded from a TOML file or made with defaults."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from .errors import Config


@dataclass
class Settings:
    library: str = "library"
    limit: int = 20

    @classmethod
    def load_or_create(cls, path: str) -> Settings:
        file = Path(path)
        if not file.exists():
            made = cls()
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text("".join(f"{k} = {v!r}\n".replace("'", '"') for k, v in asdict(made).items()), encoding="utf-8")
            return made
        try:
            found = tomllib.loads(file.read_text(encoding="utf-8"))
        except tomllib.TOMLDecodeError as error:
            raise Config(f"{path}: {error}") from error
        return cls(**{f.name: found[f.name] for f in fields(cls) if f.name in found})
