"""Engine settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Paths of an installation and the ranking parameters; nothing is created at import."""

    corpus: str | None = None
    stopwords: str | None = None
    protected_words: str | None = None
    output: str = "outputs"
    k1: float = 1.2
    b: float = 0.75
    top_k_interactive: int = 500
    top_k_batch: int = 10
    default_k: int = 50
