"""Settings from the environment, checked once on the driver."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from chunkweave.operators.chunking import check_sizes


def whole_number(environment: Mapping[str, str], name: str, default: int) -> int:
    raw = (environment.get(name) or "").strip()
    if not raw:
        return default
    try:
        return int(raw)
    except ValueError:
        raise ValueError(f"{name} must be a whole number, not {raw!r}") from None


@dataclass(frozen=True)
class Settings:
    collection: str = "collection"
    chunk_size: int = 1000
    chunk_overlap: int = 150
    dimension: int = 64
    top_k: int = 4
    threshold: float | None = None
    attempts: int = 5
    base_delay: float = 5.0

    def __post_init__(self) -> None:
        check_sizes(self.chunk_size, self.chunk_overlap)

    @classmethod
    def from_env(cls, environment: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if environment is None else environment
        number = lambda name, default: whole_number(env, name, default)
        return cls(env.get("COLLECTION") or cls.collection, number("CHUNK_SIZE", cls.chunk_size), number("CHUNK_OVERLAP", cls.chunk_overlap), number("DIMENSION", cls.dimension), number("TOP_K", cls.top_k))
