"""Settings of runs, with the rules they keep to, read from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.8
    val: float = 0.1
    test: float = 0.1
    rare_relation_min_count: int = 10
    seed: int = 42

    def faults(self) -> list[str]:
        out = [f"split.{n} must be from 0 to 1" for n in ("train", "val", "test") if not 0 <= getattr(self, n) <= 1]
        if abs(self.train + self.val + self.test - 1) > 1e-6:
            out.append("split ratios must add up to 1")
        return out


@dataclass(frozen=True)
class SamplerConfig:
    fan_out: tuple[int, ...] = (8, 3)
    hops: int = 2
    max_nodes: int = 6400
    max_images: int = 500

    def faults(self) -> list[str]:
        out = [] if self.fan_out and all(k > 0 for k in self.fan_out) else ["sampler.fan_out must have numbers over 0"]
        return out + [f"sampler.{n} must be over 0" for n in ("hops", "max_nodes", "max_images") if getattr(self, n) <= 0]


@dataclass(frozen=True)
class ScoreConfig:
    scorer: str = "complex"
    dim: int = 256
    negatives: int = 1
    top_k: int = 10

    def faults(self) -> list[str]:
        from ..functions.vectors import SCORERS

        out = [] if self.scorer in SCORERS else [f"score.scorer must be one of {sorted(SCORERS)}"]
        return out + [f"score.{n} must be over 0" for n in ("dim", "negatives", "top_k") if getattr(self, n) <= 0]


@dataclass(frozen=True)
class ExportConfig:
    target: int = 20_000
    least: int = 10_000
    most: int = 30_000
    edge_batch: int = 2_000

    def faults(self) -> list[str]:
        return [] if 0 < self.least <= self.target <= self.most else ["export sizes must rise: least, target, most"]


@dataclass(frozen=True)
class RunConfig:
    split: SplitConfig = field(default_factory=SplitConfig)
    sampler: SamplerConfig = field(default_factory=SamplerConfig)
    score: ScoreConfig = field(default_factory=ScoreConfig)
    export: ExportConfig = field(default_factory=ExportConfig)
    early_stop_min_delta: float = 0.0
    early_stop_patience: int = 0

    @staticmethod
    def of(values: dict) -> RunConfig:
        """From nested values; unknown names and broken rules are errors."""
        sections = {"split": SplitConfig, "sampler": SamplerConfig, "score": ScoreConfig, "export": ExportConfig}
        unknown = set(values) - {f.name for f in fields(RunConfig)}
        made: dict[str, object] = {}
        for name, value in values.items():
            if name in sections:
                unknown |= {f"{name}.{k}" for k in set(value) - {f.name for f in fields(sections[name])}}
                if not unknown:
                    made[name] = sections[name](**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
            elif not unknown:
                made[name] = value
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        config = RunConfig(**made)
        faults = [x for s in sections for x in getattr(config, s).faults()]
        if config.early_stop_min_delta < 0 or config.early_stop_patience < 0:
            faults.append("early stop settings must not be under 0")
        if faults:
            raise ValueError("; ".join(faults))
        return config

    @staticmethod
    def read(path: str) -> RunConfig:
        with open(path, encoding="utf-8") as f:
            return RunConfig.of(json.load(f))
