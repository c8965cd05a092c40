"""Fundamental diagrams: flow, speed and density as functions of each other.

Each formula is written once and works on Columns (m=COLUMNS) and on numpy arrays (m=ARRAYS). Pieces are chosen with
`where`, never by products with a condition, so an infinite branch can't turn a result into NaN.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import sqrt
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

def _column(x):
    return F.lit(float(x)) if isinstance(x, (int, float)) else x


COLUMNS = SimpleNamespace(
    where=lambda c, a, b: F.when(c, a).otherwise(b), exp=F.exp, log=F.log, sqrt=F.sqrt, power=F.pow, one=lambda x: F.lit(1.0),
    maximum=lambda a, b: F.greatest(_column(a), _column(b)), minimum=lambda a, b: F.least(_column(a), _column(b)), sign=F.signum, abs=F.abs,
)


def _where(condition, a, b):
    return np.where(condition, a, b)


ARRAYS = SimpleNamespace(
    where=_where, exp=np.exp, log=np.log, sqrt=np.sqrt, power=np.power, one=np.ones_like, maximum=np.maximum, minimum=np.minimum, sign=np.sign, abs=np.abs
)

Formula = Callable[[object, SimpleNamespace], object]


@dataclass(frozen=True)
class Diagram:
    """velocity and density: each of the other. d_*: derivatives. A family without an inverse has density None."""

    name: str
    v_max: float
    rho_max: float
    rho_c: float
    flow: Formula
    velocity: Formula | None = None
    density: Formula | None = None
    d_flow: Formula | None = None
    d_velocity: Formula | None = None
    d_density: Formula | None = None


def greenshields(v_max: float, rho_max: float) -> Diagram:
    return Diagram(
        "greenshields", v_max, rho_max, rho_max / 2,
        flow=lambda r, m: v_max * r * (1.0 - r / rho_max),
        velocity=lambda r, m: v_max * (1.0 - r / rho_max),
        density=lambda v, m: rho_max * (1.0 - v / v_max),
        d_flow=lambda r, m: v_max * (1.0 - 2.0 * r / rho_max),
        d_velocity=lambda r, m: -v_max / rho_max * m.one(r),
        d_density=lambda v, m: -rho_max / v_max * m.one(v),
    )


def triangular(rho_c: float, q_max: float, rho_max: float, rho_free: float | None = None) -> Diagram:
    v_max, w, free = q_max / rho_c, q_max / (rho_max - rho_c), rho_c / 2 if rho_free is None else rho_free
    return Diagram(
        "triangular", v_max, rho_max, rho_c,
        flow=lambda r, m: m.where(r <= rho_c, v_max * r, w * (rho_max - r)),
        velocity=lambda r, m: m.where(r <= rho_c, v_max * m.one(r), w * (rho_max / m.maximum(r, rho_c) - 1.0)),
        density=lambda v, m: m.where(v <= v_max, rho_max / (1.0 + v / w), free * m.one(v)),
        d_flow=lambda r, m: m.where(r <= rho_c, v_max * m.one(r), -w * m.one(r)),
        d_velocity=lambda r, m: m.where(r <= rho_c, 0.0 * m.one(r), -w * rho_max / (m.maximum(r, rho_c) * m.maximum(r, rho_c))),
        d_density=lambda v, m: m.where(v <= v_max, -rho_max / w / ((1.0 + v / w) * (1.0 + v / w)), 0.0 * m.one(v)),
    )


def three_parameter(steepness: float, p: float, rho_max: float, alpha: float) -> Diagram:
    a, b = sqrt(1 + (steepness * p) ** 2), sqrt(1 + (steepness * (1 - p)) ** 2)
    top = rho_max * (p + (b - a) / (steepness * sqrt(abs(steepness**2 - (b - a) ** 2))))

    def bend(r):
        return steepness * (r / rho_max - p)

    return Diagram(
        "three_parameter", alpha * (b - a + steepness**2 * p / a) / rho_max, rho_max, top,
        flow=lambda r, m: alpha * (a + (b - a) * r / rho_max - m.sqrt(1.0 + bend(r) * bend(r))),
        d_flow=lambda r, m: alpha / rho_max * ((b - a) - steepness * bend(r) / m.sqrt(1.0 + bend(r) * bend(r))),
    )


def quadratic_linear(v_max: float, rho_max: float, rho_c: float) -> Diagram:
    """The derivative of density by speed is negative on both branches (one source has the sign of the congested
    branch reversed)."""
    v_c, back = v_max * (1 - rho_c / rho_max), rho_max / rho_c / v_max
    return Diagram(
        "quadratic_linear", v_max, rho_max, rho_c,
        flow=lambda r, m: m.where(r < rho_c, v_max * r * (1.0 - r / rho_max), rho_c * v_max * (1.0 - r / rho_max)),
        velocity=lambda r, m: m.where(r < rho_c, v_max * (1.0 - r / rho_max), rho_c * v_max * (1.0 / m.maximum(r, rho_c) - 1.0 / rho_max)),
        density=lambda v, m: m.where(v > v_c, rho_max * (1.0 - v / v_max), rho_max / (1.0 + v * back)),
        d_flow=lambda r, m: m.where(r < rho_c, v_max * (1.0 - 2.0 * r / rho_max), -v_max * rho_c / rho_max * m.one(r)),
        d_velocity=lambda r, m: m.where(r < rho_c, -v_max / rho_max * m.one(r), -rho_c * v_max / (m.maximum(r, rho_c) * m.maximum(r, rho_c))),
        d_density=lambda v, m: m.where(v > v_c, -rho_max / v_max * m.one(v), -rho_max * back / ((1.0 + v * back) * (1.0 + v * back))),
    )


def other_quadratic_linear(v_max: float, rho_max: float, rho_c: float, w: float = 4.0) -> Diagram:
    top = 2 * rho_c
    v_c = v_max / 2
    return Diagram(
        "other_quadratic_linear", v_max, rho_max, rho_c,
        flow=lambda r, m: m.where(r < rho_c, v_max * r * (1.0 - r / top), w * (rho_max - r)),
        velocity=lambda r, m: m.where(r < rho_c, v_max * (1.0 - r / top), w * (rho_max / m.maximum(r, rho_c) - 1.0)),
        density=lambda v, m: m.where(v > v_c, top * (1.0 - v / v_max), rho_max / (1.0 + v / w)),
        d_velocity=lambda r, m: m.where(r < rho_c, -v_max / top * m.one(r), -w * rho_max / (m.maximum(r, rho_c) * m.maximum(r, rho_c))),
        d_density=lambda v, m: m.where(v > v_c, -top / v_max * m.one(v), -rho_max / w / ((1.0 + v / w) * (1.0 + v / w))),
    )


def zero_flow() -> Diagram:
    """No physics: nothing flows, and the state is the speed itself."""
    same = lambda x, m: 1.0 * x
    one = lambda x, m: m.one(x)
    return Diagram("zero", 30.0, 1.0, 0.0, lambda r, m: 0.0 * r, same, same, lambda r, m: 0.0 * r, one, one)


def power_law(v_max: float, rho_max: float, gamma: float) -> Diagram:
    return Diagram(
        "power_law", v_max, rho_max, rho_max * (1 / (1 + gamma)) ** (1 / gamma),
        flow=lambda r, m: v_max * r * (1.0 - m.power(r / rho_max, gamma)),
        velocity=lambda r, m: v_max * (1.0 - m.power(r / rho_max, gamma)),
        density=lambda v, m: rho_max * m.power(m.maximum(v_max - v, 0.0) / v_max, 1.0 / gamma),
        d_flow=lambda r, m: v_max * (1.0 - (1.0 + gamma) * m.power(r / rho_max, gamma)),
        d_velocity=lambda r, m: -v_max * gamma * m.power(r / rho_max, gamma - 1.0) / rho_max,
        d_density=lambda v, m: -rho_max / (gamma * v_max) * m.power(m.maximum(v_max - v, 1e-9) / v_max, 1.0 / gamma - 1.0),
    )


def del_castillo(v_max: float, rho_max: float, c_jam: float) -> Diagram:
    """The inner exponent is held below 10: it grows without bound towards an empty road, where speed is v_max anyway."""

    def inner(r, m):
        return m.minimum(c_jam / v_max * (1.0 - rho_max / m.maximum(r, 1e-6)), 10.0)

    velocity = lambda r, m: v_max * (1.0 - m.exp(1.0 - m.exp(inner(r, m))))
    return Diagram(
        "del_castillo", v_max, rho_max, rho_max / 4,
        flow=lambda r, m: r * velocity(r, m),
        velocity=velocity,
        density=lambda v, m: rho_max / (1.0 - v_max / c_jam * m.log(m.maximum(1.0 - m.log(m.maximum(1.0 - v / v_max, 1e-6)), 1e-6))),
        d_velocity=lambda r, m: c_jam * rho_max / m.maximum(r * r, 1e-6) * m.exp(1.0 - m.exp(inner(r, m)) + inner(r, m)),
    )


def congested(rho_max: float, v_max: float) -> Diagram:
    """Full flow below half the jam density, Greenshields above."""
    top, half = v_max * rho_max / 4, rho_max / 2
    return Diagram(
        "congested", v_max, rho_max, half,
        flow=lambda r, m: m.where(r < half, top * m.one(r), v_max * r * (1.0 - r / rho_max)),
        velocity=lambda r, m: m.where(r < half, top / m.maximum(r, rho_max / 4), v_max * (1.0 - r / rho_max)),
        density=lambda v, m: m.where(v > v_max / 2, top / m.maximum(v, v_max / 2), rho_max * (1.0 - v / v_max)),
        d_velocity=lambda r, m: m.where(r < half, m.where(r > rho_max / 4, -top / (m.maximum(r, rho_max / 4) * m.maximum(r, rho_max / 4)), 0.0 * m.one(r)), -v_max / rho_max * m.one(r)),
    )


def piecewise_quadratic(v_max: float, rho_max: float, rho_c: float, q_max: float) -> Diagram:
    """The density of a congested speed is the usual approximation, not the exact inverse."""
    v_c, free = q_max / rho_c, rho_c / (1 - q_max / (v_max * rho_c))
    scale = q_max / (rho_c - rho_max) ** 2
    jam = lambda r: scale * (r - rho_max) * (2.0 * rho_c - rho_max - r)
    return Diagram(
        "piecewise_quadratic", v_max, rho_max, rho_c,
        flow=lambda r, m: m.where(r < rho_c, v_max * r * (1.0 - r / free), jam(r)),
        velocity=lambda r, m: m.where(r < rho_c, v_max * (1.0 - r / free), jam(r) / m.maximum(r, rho_c)),
        density=lambda v, m: m.where(v > v_c, free * (1.0 - v / v_max), rho_max / (1.0 + v / v_max * rho_max / rho_c)),
        d_velocity=lambda r, m: m.where(r < rho_c, -v_max / free * m.one(r), scale * (2.0 * rho_max * rho_c - rho_max**2 - r * r) / (m.maximum(r, rho_c) * m.maximum(r, rho_c))),
    )


@dataclass(frozen=True)
class SecondOrder:
    """Two-variable traffic (density r, momentum q) with the hesitation h(r) = V(0) - V(r)."""

    diagram: Diagram
    tau: float = 5.0

    def h(self, r, m):
        return self.diagram.velocity(0.0 * r, m) - self.diagram.velocity(r, m)

    def v(self, r, q, m):
        return q / m.maximum(r, 1e-6) - self.h(r, m)

    def q(self, r, v, m):
        return r * (v + self.h(r, m))

    def r_dh(self, r, m):
        return -r * self.diagram.d_velocity(r, m)

    def flux(self, r, q, m):
        h = self.h(r, m)
        return q - r * h, q * q / m.maximum(r, 1e-6) - q * h

    def source(self, r, q, m):
        return (r * self.diagram.velocity(r, m) + r * self.h(r, m) - q) / self.tau

    def speeds(self, r, q, m):
        v = self.v(r, q, m)
        return v - self.r_dh(r, m), v


@dataclass(frozen=True)
class ModifiedSecondOrder:
    """A singular hesitation, with density clipped inside (0, rho_max)."""

    v_max: float = 20.0
    rho_max: float = 1.0
    tau: float = 5.0
    gamma: float = 0.1

    def _clipped(self, r, m):
        return m.minimum(m.maximum(r / self.rho_max, 1e-6), 1 - 1e-6)

    def h(self, r, m):
        y = self._clipped(r, m)
        return 25.0 * m.power(y, 2 * self.gamma) / m.power(m.maximum(1.0 - y, 1e-6), self.gamma)

    def r_dh(self, r, m):
        y = self._clipped(r, m)
        return 25.0 * self.gamma * (2.0 - y) * m.power(y, 2 * self.gamma) / m.power(m.maximum(1.0 - y, 1e-6), 1 + self.gamma)

    def v_eq(self, r, m):
        y = self._clipped(r, m)
        g = lambda z: m.sqrt(1.0 + (10.0 * (z - 1.0 / 3)) * (10.0 * (z - 1.0 / 3)))
        g0, g1 = sqrt(1 + (10 / 3) ** 2), sqrt(1 + (20 / 3) ** 2)
        return self.v_max / 20.0 * 1.4976 * (g0 + (g1 - g0) * y - g(y)) / y


@dataclass(frozen=True)
class ConvexSpeed:
    """Flow of the speed equation, convex in the speed: q / 2 * x^2 + max(a x + b over the lines), x = v / scale."""

    q: float
    lines: tuple[tuple[float, float], ...]
    scale: float = 40.0

    def __post_init__(self):
        if self.q <= 0 or not self.lines:
            raise ValueError("q must be positive, and there must be a line")

    def flow(self, v, m):
        x = v / self.scale
        top = self.lines[0][0] * x + self.lines[0][1]
        for a, b in self.lines[1:]:
            top = m.maximum(top, a * x + b)
        return 0.5 * self.q * x * x + top

    @property
    def v_c(self) -> float:
        """The speed of least flow: where one line's own parabola is least, or where two lines cross."""
        at = [-a / self.q for a, _ in self.lines]
        at += [(d - b) / (a - c) for a, b in self.lines for c, d in self.lines if a > c]
        return self.scale * min(at, key=lambda x: (0.5 * self.q * x * x + max(a * x + b for a, b in self.lines), x))


# The named parameter sets of the study areas.
DEFAULTS = {
    "ngsim_greenshields": greenshields(32.9, 0.0611),
    "ngsim_triangular": triangular(0.038, 0.493, 0.096),
    "ngsim_quadratic_linear": quadratic_linear(32.9, 0.096, 0.038),
    "mobile_triangular_low": triangular(0.0186, 0.56, 0.127),
    "mobile_triangular": triangular(0.022, 0.63, 0.094, 0.018),
    "mobile_quadratic_linear": quadratic_linear(29.05, 0.094, 0.022),
    "mobile_greenshields": greenshields(29.05, 0.094),
}

#: One member of every family, scaled to the densities of the test corridors.
FAMILIES = {
    "greenshields": greenshields(30.0, 0.2),
    "triangular": triangular(0.06, 1.8, 0.2),
    "three_parameter": three_parameter(10.0, 0.3, 0.2, 0.4),
    "quadratic_linear": quadratic_linear(30.0, 0.2, 0.06),
    "other_quadratic_linear": other_quadratic_linear(30.0, 0.2, 0.05),
    "zero": zero_flow(),
    "power_law": power_law(30.0, 0.2, 1.5),
    "del_castillo": del_castillo(30.0, 0.2, -5.0),
    "congested": congested(0.2, 30.0),
    "piecewise_quadratic": piecewise_quadratic(30.0, 0.2, 0.06, 1.4),
}


def diagram(name: str) -> Diagram:
    """A named family or parameter set; unknown names are refused."""
    found = FAMILIES.get(name) or DEFAULTS.get(name)
    if found is None:
        raise ValueError(f"no diagram {name!r}")
    return found
