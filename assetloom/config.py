"""Configuration: a YAML file checked into a frozen object on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Crawler:
    depth: int = 5
    javascript: bool = True


@dataclass(frozen=True)
class Download:
    timeout: int = 15
    retries: int = 3


@dataclass(frozen=True)
class Config:
    threads: int = 50
    crawler: Crawler = field(default_factory=Crawler)
    download: Download = field(default_factory=Download)
    database_path: str = "output/database/recon.db"


#: (key, field's holder, field, check, what it must be)
_whole = lambda low: lambda v: type(v) is int and v >= low
_RULES = [
    ("threads", None, "threads", _whole(1), "a positive integer"),
    ("crawler.depth", "crawler", "depth", _whole(1), "a positive integer"),
    ("crawler.javascript", "crawler", "javascript", lambda v: type(v) is bool, "a boolean"),
    ("download.timeout", "download", "timeout", _whole(1), "a positive integer"),
    ("download.retries", "download", "retries", _whole(0), "a non-negative integer"),
    ("database.path", "database", "path", lambda v: isinstance(v, str) and v != "", "a non-empty string"),
]


def parse(data: object) -> Config:
    """Check a parsed document. Errors name the key; absent keys and empty sections take the defaults."""
    data = {} if data is None else data
    if not isinstance(data, dict):
        raise ValueError("the root of the configuration must be a mapping")
    found: dict[str | None, dict] = {None: {}}
    for section in ("crawler", "download", "database"):
        value = data.get(section)
        if value is not None and not isinstance(value, dict):
            raise ValueError(f"{section} must be a mapping")
        found[section] = {}
    for key, section, name, holds, what in _RULES:
        place = data if section is None else data.get(section) or {}
        if name in place:
            if not holds(place[name]):
                raise ValueError(f"{key} must be {what}")
            found[section][name] = place[name]
    where = {"database_path": found["database"]["path"]} if found["database"] else {}
    return Config(**found[None], crawler=Crawler(**found["crawler"]), download=Download(**found["download"]), **where)


def load(path: str | Path) -> Config:
    """Read a YAML file."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    return parse(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
