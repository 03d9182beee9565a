"""Settings of the selection dataflow, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SelectionConfig:
    """Window, tier and ratio settings; frames come in units of two, the tubelets."""

    window_frames: int = 16
    stride_frames: int = 2
    fps: float = 1.0
    coarse_size: int = 256
    fine_size: int = 512
    patch_size: int = 16
    merge: int = 2
    keep_ratio: float = 0.10
    recent_keep_ratio: float = 0.40
    tail_keep_frames: int = 4
    recent_frames: int = 32
    drop_bootstrap: bool = True
    min_cell_keep: bool = True
    cell_grid_size: int = 4
    score_mode: str = "rank"
    warmup_min: int = 100
    record_keep_masks: bool = False

    def __post_init__(self):
        if self.fine_size != 2 * self.coarse_size:
            raise ValueError("the fine size must be twice the coarse size")
        if not 0 < self.keep_ratio <= 1 or not 0 < self.recent_keep_ratio <= 1:
            raise ValueError("ratios must lie in (0, 1]")
        if self.score_mode not in ("rank", "zscore", "quantile"):
            raise ValueError(f"unknown score mode {self.score_mode}")

    @property
    def grid(self) -> int:
        """Patches along a side of the coarse grid."""
        return self.coarse_size // self.patch_size
