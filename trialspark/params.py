"""Parameters of the operators, as literals of their plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TrackerParams:
    near_factor: float = 1.5
    shrink_fraction: float = 0.25
    shrink_window: int = 5
    nose_window: int = 10
    nose_speed: float = 1.5


@dataclass(frozen=True)
class InvestigationParams:
    radius_factor: float = 1.5
    min_frames: int = 3


@dataclass(frozen=True)
class StrategyParams:
    directness: float = 0.7
    max_errors: int = 1
    serial_order: float = 0.7
    center_fraction: float = 0.2


@dataclass(frozen=True)
class DetectionParams:
    mode: str = "otsu"
    fixed_threshold: int = 30
    min_threshold: int = 18
    open_radius: int = 2
    min_area: int = 60
    max_area: int = 8000


@dataclass(frozen=True)
class MazeParams:
    min_hole_area: int = 12
    max_hole_area: int = 900
    fallback_holes: int = 20
    hole_open_radius: int = 1
