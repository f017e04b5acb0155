"""Settings as frozen dataclasses: loading, checks, and overrides by dotted path."""

from __future__ import annotations

import ast
import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class SamplingConfig:
    strategy: str = "sans"
    n_positives: int = 125
    n_negatives: int = 24
    seed: int = 42
    near_limit: float = 4.0
    near_share: float = 0.65
    far_share: float = 0.35
    alpha: float = 1.5
    missing_distance: float = 12.0
    anchor_level: list[int] | None = None
    excluded: bool | None = None

    def __post_init__(self) -> None:
        if self.strategy not in ("sans", "phase1", "uniform"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.near_share <= 0 or self.far_share <= 0:
            raise ValueError("bucket shares must be above 0")
        if not 1 <= self.n_positives <= 2125 or self.n_negatives < 1:
            raise ValueError("numbers of positives or negatives are out of range")


@dataclass(frozen=True)
class CurriculumConfig:
    epochs: int = 15
    phase1_end: float = 0.3
    phase2_end: float = 0.7
    two_phase: bool = False
    anneal_epochs: int = 10
    alpha_start: float = 2.0
    alpha_end: float = 1.0

    def __post_init__(self) -> None:
        if not 0 < self.phase1_end < self.phase2_end <= 1:
            raise ValueError("phases must end in order, between 0 and 1")
        if self.epochs < 1 or self.anneal_epochs < 1:
            raise ValueError("numbers of epochs must be 1 at least")
        if self.alpha_start <= 0 or self.alpha_end <= 0:
            raise ValueError("alphas must be above 0")


@dataclass(frozen=True)
class ModelConfig:
    n_experts: int = 4
    top_k: int = 2
    temperature: float = 0.07
    curvature: float = 1.0

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= self.n_experts:
            raise ValueError("top_k must lie between 1 and the number of experts")
        if self.temperature <= 0 or self.curvature <= 0:
            raise ValueError("temperature and curvature must be above 0")


@dataclass(frozen=True)
class LossConfig:
    contrastive: float = 1.0
    balance: float = 0.01
    hierarchy: float = 0.325
    rank: float = 0.275
    radius: float = 0.01

    def __post_init__(self) -> None:
        if min(dataclasses.astuple(self)) < 0:
            raise ValueError("weights of losses must not be below 0")


@dataclass(frozen=True)
class Config:
    sampling: SamplingConfig = field(default_factory=SamplingConfig)
    curriculum: CurriculumConfig = field(default_factory=CurriculumConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    loss: LossConfig = field(default_factory=LossConfig)


def from_dict(values: dict[str, dict[str, Any]]) -> Config:
    kinds = {f.name: f.default_factory for f in dataclasses.fields(Config)}
    unknown = sorted(set(values) - set(kinds))
    unknown += sorted(f"{name}.{key}" for name, section in values.items() if name in kinds for key in set(section or {}) - {f.name for f in dataclasses.fields(kinds[name])})
    if unknown:
        raise ValueError(f"unknown settings {unknown}")
    return Config(**{name: kinds[name](**(section or {})) for name, section in values.items()})


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("settings in YAML need the yaml package; JSON files don't") from e
    return yaml


def load(path: str | None) -> Config:
    """Settings of a YAML or JSON file, by its ending; all defaults without one."""
    if path is None:
        return Config()
    with open(path, encoding="utf-8") as f:
        return from_dict(json.load(f) if path.endswith(".json") else _yaml().safe_load(f) or {})


def save(config: Config, path: str) -> None:
    """Write settings to a YAML or JSON file, by its ending; load() gives them back."""
    values = dataclasses.asdict(config)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(values, indent=2) if path.endswith(".json") else _yaml().safe_dump(values, sort_keys=False))


def parsed(text: str) -> Any:
    """An override's value: boolean, null, number, literal, or else the text itself."""
    words = {"true": True, "false": False, "null": None, "none": None}
    if text.lower() in words:
        return words[text.lower()]
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def overridden(config: Config, *changes: str) -> Config:
    """Settings with changes like `sampling.seed=7`; unknown names raise."""
    for change in changes:
        path, _, text = change.partition("=")
        section, _, name = path.partition(".")
        part = getattr(config, section, None)
        if part is None or name not in {f.name for f in dataclasses.fields(part)}:
            raise ValueError(f"unknown setting {path!r}")
        config = dataclasses.replace(config, **{section: dataclasses.replace(part, **{name: parsed(text)})})
    return config
