"""Policies of scoring, retrieval and cutting, with their validation."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

# Fixed values, which results depend on.
MAD_SCALE = 1.4826
EPSILON = 1e-12
GENERIC_NAMES = ("概述", "原理", "总结", "简介", "介绍", "overview", "summary", "introduction")
CROSS_DEFAULT_LENS = 50
EXCERPT = 80
SEARCH_EXCERPT = (80, 120)
SEARCH_WEIGHTS = (3.0, 1.0)  # title, body
BM25_K1, BM25_B = 1.2, 0.75


def _unit(**values: float) -> None:
    for name, v in values.items():
        if not (math.isfinite(v) and 0 <= v <= 1):
            raise ValueError(f"{name} must be from 0 to 1")


@dataclass(frozen=True)
class ScorePolicy:
    version: str = "mention-explicit-v1"
    mention_base: float = 0.5
    section_increment: float = 0.1
    mention_cap: float = 0.8
    explicit_boost: float = 0.3

    def __post_init__(self):
        if not self.version.strip():
            raise ValueError("version must not be blank")
        _unit(mention_base=self.mention_base, section_increment=self.section_increment, mention_cap=self.mention_cap, explicit_boost=self.explicit_boost)
        if self.mention_base > self.mention_cap:
            raise ValueError("mention_base must not exceed mention_cap")


@dataclass(frozen=True)
class BoundaryPolicy:
    mad_multiplier: float = 3.5
    minimum_gap: float = 0.01
    minimum_rank: int = 2
    minimum_candidates: int = 4
    quality_floor: float = 0.55

    def __post_init__(self):
        _unit(minimum_gap=self.minimum_gap, quality_floor=self.quality_floor)
        if not (math.isfinite(self.mad_multiplier) and self.mad_multiplier >= 0) or self.minimum_rank < 1 or self.minimum_candidates < 2:
            raise ValueError("invalid boundary policy")


@dataclass(frozen=True)
class Retrieval:
    budget: int = 100
    aggregation: str = "max"
    top_matches: int = 3
    mappings: dict[str, tuple[float, float]] = field(default_factory=lambda: {"text-text": (0.2, 0.9), "text-image": (0.15, 0.9), "image-image": (0.2, 0.95)})

    def __post_init__(self):
        if self.budget < 1 or self.top_matches < 1 or self.aggregation not in ("max", "top-mean"):
            raise ValueError("invalid retrieval")
        for low, high in self.mappings.values():
            if not -1 <= low < high <= 1:
                raise ValueError("a mapping's minimum must be under its maximum")


@dataclass(frozen=True)
class Chunking:
    strategy: str = "section-tokens-v1"
    max_tokens: int = 512
    image_context: int = 400


@dataclass(frozen=True)
class EmbeddingSpace:
    model: str
    revision: str
    dimensions: int
    normalized: bool
    modalities: tuple[str, ...] = ("text",)
    mode: str = "text"
    chunking: Chunking = Chunking()

    @property
    def id(self) -> str:
        """Retrieval settings do not change a space; descriptor, mode and chunking do."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def changed_policy(old: ScorePolicy, new: ScorePolicy) -> ScorePolicy:
    """The new policy; other weights need another version."""
    if old != new and old.version == new.version:
        raise ValueError("a changed policy needs a new version")
    return new
