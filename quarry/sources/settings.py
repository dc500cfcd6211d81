"""Settings as dataclasses: from YAML, the environment and dotted overrides."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any


@dataclass
class Embedding:
    model: str = "hashing"
    dimension: int = 256
    normalize: bool = True


@dataclass
class Retrieval:
    k: int = 5
    metric: str = "cosine"
    hybrid: bool = False
    alpha: float = 0.5
    rrf_k: int = 60


@dataclass
class Generation:
    model: str = "extractive"
    template: str = "default"
    most_words: int = 2048


@dataclass
class Chunking:
    strategy: str = "recursive"
    size: int = 512
    overlap: int = 64
    least: int = 20


@dataclass
class Config:
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)
    chunking: Chunking = field(default_factory=Chunking)
    seed: int = 42

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as lines:
            return _filled(cls(), yaml.safe_load(lines) or {})

    def override(self, given: dict[str, Any]) -> Config:
        """Set values by dotted name, such as retrieval.k; texts are read as the type of the value before."""
        for name, value in given.items():
            *path, last = name.split(".")
            part = self
            for p in path:
                part = getattr(part, p)
            setattr(part, last, _as(type(getattr(part, last)), value))
        return self

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def _as(kind: type, value: Any) -> Any:
    if kind is bool and isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes", "on")
    return value if isinstance(value, kind) else kind(value)


def _filled(part: Any, given: dict[str, Any]) -> Any:
    for f in fields(part):
        if f.name in given:
            now = getattr(part, f.name)
            setattr(part, f.name, _filled(now, given[f.name]) if is_dataclass(now) else _as(type(now), given[f.name]))
    return part


def get(variable: str = "QUARRY_CONFIG") -> Config:
    """Settings of the file that the environment names, else the defaults."""
    path = os.environ.get(variable)
    return Config.from_yaml(path) if path else Config()
