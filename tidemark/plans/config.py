"""Settings of a run, read from and written to YAML."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields


@dataclass
class Model:
    name: str = "hashing"
    dimension: int = 384
    dtype: str = "float32"
    batch_size: int = 32


@dataclass
class Clustering:
    default_k: int = 6
    auto_k: bool = False
    k_rule: str = "silhouette"
    k_min: int = 2
    k_max: int = 10
    cos_thresh: float = 0.5
    drift_cos_drop: float = 0.2
    term_jaccard_drop: float = 0.60
    emerge_min: int = 30
    min_events_per_week: int = 5


@dataclass
class TimeAware:
    half_life_days: float = 14.0
    alpha: float = 0.7


@dataclass
class Paths:
    root: str = "."

    def at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    logs = property(lambda self: self.at("logs"))
    events = property(lambda self: self.at("data", "events.parquet"))
    embedded = property(lambda self: self.at("data", "events_embedded.parquet"))
    results = property(lambda self: self.at("results"))


@dataclass
class Config:
    model: Model = field(default_factory=Model)
    clustering: Clustering = field(default_factory=Clustering)
    time_aware: TimeAware = field(default_factory=TimeAware)
    paths: Paths = field(default_factory=Paths)

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        """Nested settings; unknown names raise."""
        kinds = {f.name: f.default_factory for f in fields(cls)}
        if unknown := set(data) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: kinds[k](**(v or {})) for k, v in data.items()})

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        """The file's settings, or the defaults if there is no file."""
        if not os.path.exists(path):
            return cls()
        import yaml

        with open(path) as f:
            return cls.from_dict(yaml.safe_load(f) or {})

    def to_yaml(self, path: str) -> None:
        import yaml

        with open(path, "w") as f:
            yaml.safe_dump(asdict(self), f, sort_keys=False)
