"""Settings of a run, in one place; every operator also takes them as arguments."""

from __future__ import annotations

import os
import socket
from dataclasses import dataclass, field


@dataclass(frozen=True)
class LoopSettings:
    """Thresholds of the four loop detectors."""

    window_chars: int = 100
    window_count: int = 3
    rep_n: int = 3
    rep_threshold: float = 0.5
    rep_min_tokens: int = 150
    rep_interval: int = 500
    rep_window_tokens: int = 1000
    cosine_lines: int = 10
    cosine_threshold: float = 0.85
    cosine_min_lines: int = 20
    cosine_pairs: float = 0.6
    block_count: int = 3
    block_min_lines: int = 6
    block_min_chars: int = 10
    active: frozenset[int] = frozenset({1, 2, 3, 4})
    block_offset: str = "code"  # or "documented": the first line of the second block


@dataclass(frozen=True)
class Settings:
    """Defaults of the de-identification run."""

    ngram_max: int = 101
    ngram_min: int = 10
    min_subjects: int = 5
    min_chars_safe: int = 15
    min_words_safe: int = 3
    attempts: int = 3
    num_ctx: int = 24576
    num_predict: int = 20000
    temperature: float = 0.1
    inject_reasoning: bool = True
    first_gold_id: int = 875
    fp_min_chars: int = 3
    loops: LoopSettings = field(default_factory=LoopSettings)


def settings_for(profiles: dict[str, Settings], default: str, host: str | None = None) -> Settings:
    """The profile of this host (or of ``VELATURA_PROFILE``); the default where it has none."""
    return profiles.get(os.environ.get("VELATURA_PROFILE") or host or socket.gethostname(), profiles[default])
