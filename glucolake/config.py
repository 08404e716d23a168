"""Parameters of the operators, with the defaults of clinical practice."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

MMOL_TO_MG = 18.0182
MMOL_NAMES = ("mmol/l", "mmol", "mmol/liter", "mmoll")
DAYTIME_START_MINUTE = 360


@dataclass(frozen=True)
class Thresholds:
    """Glucose limits in mg/dL."""

    tbr_level2: float = 54.0
    tir_lower: float = 70.0
    tir_upper: float = 180.0
    tar_level2: float = 250.0

    def __post_init__(self):
        if not self.tbr_level2 < self.tir_lower < self.tir_upper < self.tar_level2:
            raise ValueError("thresholds must rise: tbr_level2 < tir_lower < tir_upper < tar_level2")


@dataclass(frozen=True)
class QcParams:
    valid_day_hours: float = 14.0
    glucose_min: float = 40.0
    glucose_max: float = 400.0
    gap_factor: float = 1.5
    low_coverage_percent: int = 80


@dataclass(frozen=True)
class ComplexityParams:
    min_points: int = 100
    bin_width: float = 10.0
    embedding: int = 2
    scales: int = 5
    kmax: int = 8
    tolerance: float = 0.15
    thin_to: int | None = 1000


@dataclass(frozen=True)
class FunctionalParams:
    grid_minutes: int = 5
    nbasis: int = 15
    smoothing: float = 0.01
    min_slots: int = 24
    components: int = 2
    clusters: int = 3
    low: float = 0.0
    high: float = 500.0
    basis: str = "bspline"

    def __post_init__(self):
        if self.basis not in ("bspline", "fourier", "smoothing_spline"):
            raise ValueError("basis is 'bspline', 'fourier' or 'smoothing_spline'")


@dataclass(frozen=True)
class PredictiveParams:
    horizon_minutes: int = 30
    target: str = "low"
    model: str = "logistic"
    min_examples: int = 80
    min_events: int = 5
    threshold: float = 0.5
    lag_minutes: tuple[int, ...] = (5, 15, 30, 60)
    window_minutes: tuple[int, ...] = (15, 30, 60)
    trees: int = 200

    def normalized(self) -> PredictiveParams:
        """The horizon is 30 or 60 minutes, the threshold within [0.01, 0.99], names are known ones."""
        return dataclasses.replace(
            self, horizon_minutes=60 if self.horizon_minutes >= 45 else 30, threshold=min(0.99, max(0.01, self.threshold)),
            target="high" if self.target == "high" else "low", model="random_forest" if self.model == "random_forest" else "logistic",
        )


@dataclass(frozen=True)
class Settings:
    """Everything a run depends on, for a reproducible log."""

    thresholds: Thresholds = field(default_factory=Thresholds)
    qc: QcParams = field(default_factory=QcParams)
    complexity: ComplexityParams = field(default_factory=ComplexityParams)
    functional: FunctionalParams = field(default_factory=FunctionalParams)
    predictive: PredictiveParams = field(default_factory=PredictiveParams)
    interval_minutes: int = 5
    date_range: tuple[str, str] | None = None
    expected_duration_days: int | None = None
    units: str = "mg/dL"
    timestamp_date_order: str = "dmy"
    timestamp_parser: str = "compatibility"
    imputation_model: str = "auto"
    seed: int = 42

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True, indent=2)


def interval(minutes: float | None) -> int:
    """A grid interval; what isn't a positive number counts as 5 minutes."""
    try:
        n = int(minutes)
    except (TypeError, ValueError, OverflowError):
        return 5
    return n if n > 0 else 5
