"""Settings: defaults, overlaid by a global and then a project file in TOML (CFG1-CFG4, SRC10)."""

from __future__ import annotations

import dataclasses
import tomllib
from pathlib import Path
from typing import Any

from threadloom.functions.redact import REDACTION_VERSION
from threadloom.functions.text import expand_path


@dataclasses.dataclass(frozen=True)
class Embedding:
    provider: str = "stub"
    model: str = "stub"
    dimension: int = 1024
    intra_threads: int = 4


@dataclasses.dataclass(frozen=True)
class Database:
    path: str = "~/.threadloom/catalog"
    busy_timeout_ms: int = 5000
    wal: bool = True


@dataclasses.dataclass(frozen=True)
class Scanner:
    root: str = "~/transcripts"


@dataclasses.dataclass(frozen=True)
class Chunking:
    max_chars: int = 800


@dataclasses.dataclass(frozen=True)
class Config:
    embedding: Embedding = Embedding()
    db: Database = Database()
    scanner: Scanner = Scanner()
    chunking: Chunking = Chunking()

    def signature(self) -> str:
        """DRV3: sessions indexed under another one are out of date."""
        return f"{self.embedding.model}|{self.embedding.dimension}|{self.chunking.max_chars}|r{REDACTION_VERSION}"


def merged(base: dict, over: dict) -> dict:
    """CFG2: tables are merged, other values replaced."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def config_from(values: dict[str, Any]) -> Config:
    """Known sections and keys over the defaults; a value of another type is an error."""
    config = Config()
    for field in dataclasses.fields(Config):
        given, section = values.get(field.name, {}), getattr(config, field.name)
        if not isinstance(given, dict):
            raise TypeError(f"[{field.name}] must be a table")
        known = {f.name: given[f.name] for f in dataclasses.fields(section) if f.name in given}
        for name, value in known.items():
            if type(value) is not type(getattr(section, name)):
                raise TypeError(f"{field.name}.{name}: {value!r}")
        config = dataclasses.replace(config, **{field.name: dataclasses.replace(section, **known)})
    paths = {"db": dataclasses.replace(config.db, path=expand_path(config.db.path)), "scanner": dataclasses.replace(config.scanner, root=expand_path(config.scanner.root))}
    return dataclasses.replace(config, **paths)


#: Names of the settings files: of a user, and of a project in its own folder.
USER_FILE, PROJECT_FILE = "~/.config/threadloom/config.toml", ".threadloom.toml"


def project_file(folder: str | None = None) -> str:
    """CFG3: the settings file of a project folder, by default the current one."""
    return str((Path(folder) if folder else Path.cwd()) / PROJECT_FILE)


def config_of(folder: str | None = None) -> Config:
    """The user's settings, overlaid by those of the project."""
    return load_config(USER_FILE, project_file(folder))


def load_config(*files: str) -> Config:
    """Files in the order in which they overlay; one that is missing adds nothing."""
    values: dict[str, Any] = {}
    for file in files:
        path = Path(expand_path(file))
        if path.is_file():
            values = merged(values, tomllib.loads(path.read_text(encoding="utf-8")))
    return config_from(values)
