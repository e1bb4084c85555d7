"""Settings: defaults, then a TOML file, then QUILL_* environment variables, then arguments; checked once."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from .errors import ConfigError


@dataclass(frozen=True)
class Config:
    """Limits, excluded folders, field weights and BM25's parameters."""

    roots: tuple[str, ...] = ()
    store: str = "catalog"
    max_file_size: int = 2 << 20
    max_front_matter_size: int = 64 << 10
    max_yaml_input_size: int = 8 << 20
    max_graph_depth: int = 5
    max_graph_nodes: int = 100
    max_response_chars: int = 500_000
    exclude_patterns: tuple[str, ...] = (".git/", "node_modules/", "vendor/", "target/", ".env", "secrets/", "credentials/")
    require_index_files: bool = False
    debounce_ms: int = 500
    reconcile_seconds: int = 600
    weights: dict = field(default_factory=lambda: {"title": 10.0, "description": 5.0, "headings": 2.0, "body": 1.0, "type": 0.0})
    k1: float = 1.2
    b: float = 0.75
    max_headings: int = 1
    heading_depth: int = 1
    stem: bool = True

    def __post_init__(self):
        for name in ("max_file_size", "max_front_matter_size", "max_yaml_input_size", "max_graph_depth", "max_graph_nodes", "max_response_chars", "debounce_ms", "reconcile_seconds"):
            if getattr(self, name) <= 0:
                raise ConfigError(f"{name} must be positive")
        if any(w < 0 for w in self.weights.values()):
            raise ConfigError("weights must not be negative")
        if self.k1 <= 0 or not 0 <= self.b <= 1:
            raise ConfigError("k1 must be positive and b within 0 and 1")


def load_config(path: str | None = None, environ=os.environ, **given) -> Config:
    values: dict = {}
    if path:
        try:
            with open(path, "rb") as f:
                values.update(tomllib.load(f))
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(str(e)) from e
    kinds = {f.name: f.type for f in fields(Config)}
    unknown = values.keys() - kinds.keys()
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    for name, kind in kinds.items():
        text = environ.get(f"QUILL_{name.upper()}")
        if text is None:
            continue
        try:
            values[name] = {"int": int, "float": float, "str": str}.get(kind, lambda t: t)(text)
            if kind == "bool":
                values[name] = text.lower() in ("1", "true", "yes")
            elif kind.startswith("tuple"):
                values[name] = tuple(x for x in text.split(",") if x)
            elif kind == "dict":
                values[name] = {k: float(v) for k, v in (x.split("=") for x in text.split(","))}
        except ValueError as e:
            raise ConfigError(f"QUILL_{name.upper()}: {e}") from e
    values.update({k: v for k, v in given.items() if v is not None})
    values = {k: tuple(v) if kinds[k].startswith("tuple") and not isinstance(v, str) else v for k, v in values.items()}
    return Config(**values)
