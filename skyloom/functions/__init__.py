"""Column functions: complex numbers, gridding kernels, beams and angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LIGHT = 299792458.0
#: The rational approximation of the spheroidal function, by segment (end, numerator, denominator).
SPHEROIDAL = (
    (0.75, (8.203343e-2, -3.644705e-1, 6.278660e-1, -5.335581e-1, 2.312756e-1), (1.0, 8.212018e-1, 2.078043e-1)),
    (1.0, (4.028559e-3, -3.697768e-2, 1.021332e-1, -1.201436e-1, 6.412774e-2), (1.0, 9.599102e-1, 2.918724e-1)),
)


def spheroidal(u: Column) -> Column:
    """The grid correction at the distance ``u`` (0 centre, 1 edge); the kernel is ``(1 - u**2)`` times it."""
    x = F.abs(u)

    def piece(end: float, top: tuple[float, ...], bottom: tuple[float, ...]) -> Column:
        d = x * x - F.lit(end * end)
        horner = lambda cs: sum_horner(cs, d)
        return horner(top) / horner(bottom)

    return F.when(x > 1, 0.0).when(x < 0.75, piece(*SPHEROIDAL[0])).otherwise(piece(*SPHEROIDAL[1]))


def sum_horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def spheroidal_value(u: float) -> float:
    """``spheroidal`` on the driver."""
    u = abs(u)
    if u > 1:
        return 0.0
    end, top, bottom = SPHEROIDAL[0 if u < 0.75 else 1]
    d = u * u - end * end
    return sum(c * d**k for k, c in enumerate(top)) / sum(c * d**k for k, c in enumerate(bottom))


def half_kernel(support: int = 7, oversampling: int = 100) -> list[float]:
    """The one-sided kernel, sampled; zero in its last cell."""
    n = support // 2
    inside = [(1 - (i / (n * oversampling)) ** 2) * spheroidal_value(i / (n * oversampling)) for i in range(n * oversampling)]
    return inside + [0.0] * oversampling


def bessel_j1(x: Column, points: int = 60) -> Column:
    """J1 by the trapezoid rule over one period, spectrally accurate for arguments below about half of ``points``. The sum
    is a fold over the nodes, so the plan stays small whatever their number."""
    nodes = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k * F.lit(2.0) * F.lit(math.pi) / F.lit(float(points)))
    fold = lambda v: F.aggregate(nodes, F.lit(0.0), lambda total, t: total + F.cos(t - v * F.sin(t))) / points
    return F.element_at(F.transform(F.array(x), fold), 1)  # x is computed once


def airy(r: Column, ipower: int, blockage: float = 0.0, points: int = 60) -> Column:
    """The (obscured) Airy voltage (power 1) or power (2) pattern at the reduced radius ``r``; ``blockage`` is the
    diameter ratio."""
    disk = 2 * bessel_j1(r, points) / r
    if blockage:
        disk = (disk - 2 * F.lit(blockage) * bessel_j1(r * blockage, points) / r) / (1 - blockage**2)
    return F.when(r == 0, 1.0).otherwise(F.pow(disk, F.lit(float(ipower))))


def casa_airy(r: Column, ipower: int, dish: float, blockage: float, points: int = 120) -> Column:
    """The pattern in the form with area and length ratios."""
    ratio = dish / blockage
    area = ratio * ratio
    value = (area * 2 * bessel_j1(r, points) / r - 2 * bessel_j1(r * ratio, points) / (r * ratio)) / (area - 1)
    return F.when(r == 0, 1.0).otherwise(F.pow(value, F.lit(float(ipower))))


def cmul(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def cexp(phase: Column) -> tuple[Column, Column]:
    return F.cos(phase), F.sin(phase)


def sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(F.lit(math.pi) * x) / (F.lit(math.pi) * x))


FWHM = 2 * math.sqrt(2 * math.log(2))


def fwhm_from_sigma(s: Column) -> Column:
    return s * FWHM


def sigma_from_fwhm(f: Column) -> Column:
    return f / FWHM


def theta_pa_to_math(pa: Column) -> Column:
    """Position angle (from +y towards +x) to the angle from +x towards +y; the same function goes back."""
    return F.lit(math.pi / 2) - pa


theta_math_to_pa = theta_pa_to_math


def normalize_angle(a: Column, period: float = math.pi) -> Column:
    """Into (-period/2, period/2]."""
    x = F.pmod(a + period / 2, F.lit(period)) - period / 2
    return F.when(x == -period / 2, period / 2).otherwise(x)
