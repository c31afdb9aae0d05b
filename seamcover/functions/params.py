"""Parameters of smoothing: names, defaults, units."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

#: The algorithms and the names they are known by.
ALGORITHMS = ("douglaspeucker", "chaikin", "bspline", "bezier", "gaussian")
ALIASES = {"spline": "bspline", "beziercurve": "bezier", "cubicspline": "bezier", "slidingaverage": "gaussian"}
#: The parameters that each algorithm reads.
RELEVANT = {
    "douglaspeucker": ("dp",),
    "chaikin": ("iterations", "pre", "post"),
    "bspline": ("pre", "post", "points_per_100", "degree", "smoothing"),
    "bezier": ("pre", "post", "points_per_100"),
    "gaussian": ("sigma", "post"),
}


def algorithm_name(name: str | int) -> str:
    """Canonical name of an algorithm given by index or by name, whatever its case, dashes, underscores and spaces."""
    if isinstance(name, int) or str(name).isdigit():
        if 0 <= int(name) < len(ALGORITHMS):
            return ALGORITHMS[int(name)]
    else:
        key = str(name).lower().translate(str.maketrans("", "", "-_ "))
        key = ALIASES.get(key, key)
        if key in ALGORITHMS:
            return key
    raise ValueError(f"unknown algorithm {name!r}; one of {', '.join(ALGORITHMS)}")


@dataclass(frozen=True)
class Smoothing:
    """Distances are in layer units."""

    algorithm: str = "gaussian"
    iterations: int = 4
    sigma: float = 12.5
    pre: float = 10.0
    post: float = 1.0
    dp: float = 5.0
    points_per_100: float = 5.0
    degree: int = 3
    smoothing: float = 0.0

    def __post_init__(self):
        object.__setattr__(self, "algorithm", algorithm_name(self.algorithm))
        if not 1 <= self.iterations <= 10 or not 1 <= self.degree <= 5 or self.points_per_100 < 0.01 or min(self.sigma, self.pre, self.post, self.dp) < 0:
            raise ValueError("iterations 1 to 10, degree 1 to 5, points_per_100 at least 0.01, distances not negative")

    def scaled(self, factor: float) -> Smoothing:
        """Metres to layer units."""
        if factor == 1:
            return self
        return replace(self, sigma=self.sigma * factor, pre=self.pre * factor, post=self.post * factor, dp=self.dp * factor, points_per_100=self.points_per_100 / factor)

    def signature(self) -> dict[str, float]:
        return {"algorithm": self.algorithm} | {f.name: getattr(self, f.name) for f in fields(self) if f.name in RELEVANT[self.algorithm]}


@dataclass(frozen=True)
class Crs:
    """kind: ``projected``, ``geographic`` or anything else for unknown."""

    kind: str = "unknown"
    unit_m: float = 1.0
    semi_major: float = 6378137.0
    inv_flattening: float = 298.257223563


def layer_units_per_metre(crs: Crs | None, extent: tuple[float, float, float, float]) -> tuple[float, str]:
    """Factor from metres to layer units, and a note. Degrees are taken at the middle latitude of the extent."""
    if crs is not None and crs.kind == "projected":
        return 1.0 / crs.unit_m, ""
    if crs is None or crs.kind != "geographic":
        return 1.0, "unknown reference system: distances are taken as layer units"
    latitude = math.radians(max(-85.0, min(85.0, (extent[1] + extent[3]) / 2)))
    flattening = 1 / crs.inv_flattening if crs.inv_flattening else 0.0
    e2 = flattening * (2 - flattening)
    w = 1 - e2 * math.sin(latitude) ** 2
    north = math.radians(1) * crs.semi_major * (1 - e2) / w**1.5
    east = math.radians(1) * crs.semi_major * math.cos(latitude) / math.sqrt(w)
    return 1 / math.sqrt(east * north), "degrees at the middle latitude"


def unit_factor(option: str, crs: Crs | None, extent: tuple[float, float, float, float]) -> float:
    """``crs``, ``layer`` and ``map``: 1; metres: by the reference system."""
    key = option.strip().lower()
    if key in ("crs", "layer", "map"):
        return 1.0
    if key in ("m", "meter", "meters", "metre", "metres"):
        return layer_units_per_metre(crs, extent)[0]
    raise ValueError(f"unknown unit {option!r}")


def vector_precision(crs: Crs | None) -> float:
    return 1e-9 if crs is not None and crs.kind == "geographic" else 1e-4


def tolerance_steps(tolerance: float, grid: float) -> int:
    return math.ceil(tolerance / grid)


def duration(seconds: float) -> str:
    """m:ss, or h:mm:ss from an hour on."""
    s = int(seconds)
    return f"{s // 3600}:{s % 3600 // 60:02d}:{s % 60:02d}" if s >= 3600 else f"{s // 60}:{s % 60:02d}"
