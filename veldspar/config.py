"""Configuration: defaults as dataclasses, and files in YAML that set the database, the description provider and verbosity."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any


@dataclass
class Database:
    type: str = "sqlite"
    host: str | None = None
    port: int | None = None
    database: str | None = None
    username: str | None = None
    password: str | None = None
    path: str | None = None
    schema: str | None = None

    def __post_init__(self) -> None:
        if self.type not in ("sqlite", "postgresql", "mysql"):
            raise ValueError(f"unsupported database: {self.type}")


@dataclass
class Provider:
    """Who writes descriptions: the rules of this library, unless another provider is plugged in."""

    provider: str = "rules"
    model: str | None = None
    api_key: str | None = None
    temperature: float = 0.3


@dataclass
class Profiling:
    sample_rows: int = 10_000
    null_warning: float = 0.1
    null_critical: float = 0.5
    unique: float = 0.95


@dataclass
class Output:
    folder: str = "output"
    sample_values: int = 10


@dataclass
class Config:
    database: Database = field(default_factory=Database)
    llm: Provider = field(default_factory=Provider)
    profiling: Profiling = field(default_factory=Profiling)
    output: Output = field(default_factory=Output)
    verbose: bool = False

    def as_dict(self, secrets: bool = False) -> dict[str, Any]:
        out = asdict(self)
        if not secrets:
            for part, name in (("database", "password"), ("llm", "api_key")):
                out[part][name] = "***" if out[part][name] else None
        return out


def _of(kind: type, given: dict | None):
    known = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in (given or {}).items() if k in known})


def from_dict(data: dict | None) -> Config:
    """The keys database, llm and verbose are honoured; others keep their defaults."""
    data = data or {}
    return Config(database=_of(Database, data.get("database")), llm=_of(Provider, data.get("llm")), verbose=bool(data.get("verbose", False)))


def from_yaml(path: str) -> Config:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a YAML file needs the package yaml") from e
    with open(path) as f:
        return from_dict(yaml.safe_load(f))
