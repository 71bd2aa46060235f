"""Default parameters of planning and time, all in metres, seconds and radians unless the name says otherwise."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields


def _check(record, positive: tuple[str, ...]) -> None:
    for f in fields(record):
        value = getattr(record, f.name)
        if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
            raise ValueError(f"{f.name} must be a finite number")
        if f.name in positive and value <= 0:
            raise ValueError(f"{f.name} must be positive")


@dataclass(frozen=True)
class Vehicle:
    body_width: float = 2.43
    front: float = 3.54
    rear: float = 1.0
    work_width: float = 3.75
    tool_length: float = 2.5
    tool_offset: float = -2.25
    turn_radius: float = 5.0
    margin: float = 0.5

    def __post_init__(self):
        _check(self, ("body_width", "front", "work_width", "tool_length", "turn_radius"))

    @property
    def turning_clearance(self) -> float:
        """Room that the farthest corner needs while turning."""
        reach = max(self.front, abs(self.tool_offset) + self.tool_length / 2)
        return math.hypot(self.turn_radius + max(self.body_width, self.work_width) / 2, reach) - self.turn_radius + self.margin


@dataclass(frozen=True)
class Speeds:
    work: float = 2.36
    turn: float = 0.8
    transit: float = 2.36
    reverse: float = 0.5
    ramp_seconds: float = 2.0

    def __post_init__(self):
        _check(self, ("work", "turn", "transit", "reverse", "ramp_seconds"))


@dataclass(frozen=True)
class Stops:
    gear: float = 2.0
    switch: float = 1.0
    steer: float = 2.0
    steer_angle_deg: float = 35.0

    def __post_init__(self):
        _check(self, ())


@dataclass(frozen=True)
class Planning:
    overlap: float = 0.02
    area_retention: float = 0.95
    chain_gap: float = 1e-5
    sampling: float = 0.1
    heading_step: float = 0.04
    headland_passes: int = 3
    seam_pose: float = 0.3

    def __post_init__(self):
        _check(self, ("sampling", "heading_step"))
        if not 0 <= self.overlap < 1 or not 0 < self.area_retention <= 1:
            raise ValueError("overlap and area_retention are shares")

    def spacing(self, vehicle: Vehicle) -> float:
        return vehicle.work_width * (1 - self.overlap)


def row(*records) -> dict:
    """One flat row of parameters, for hashing and storing."""
    return {k: v for r in records for k, v in asdict(r).items()}
