"""Settings of a grouping run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GroupingConfig:
    """Hash bits that may differ, seconds between shots (0: no window), and least members of a group."""

    threshold: int = 5
    window_s: int = 300
    min_size: int = 3
    video_threshold: float = 10.0

    @property
    def least(self) -> int:
        return max(self.min_size, 2)
