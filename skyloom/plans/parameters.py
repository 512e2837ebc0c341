"""Checked parameters of the operators, and the roles that columns play in a table of visibilities."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} is {value}; it lies between {low} and {high}")


def _one_of(name: str, value: str, known: tuple[str, ...]) -> None:
    if value not in known:
        raise ValueError(f"{name} is {value!r}; known are {list(known)}")


@dataclass(frozen=True)
class GridParams:
    """Side and cell (radians) of an image, the padding of its transform, and how channels are gridded."""

    image_size: int
    cell: float
    fft_padding: float = 1.2
    chan_mode: str = "cube"

    def __post_init__(self) -> None:
        if self.image_size < 1 or self.cell == 0:
            raise ValueError("an image has pixels, and a cell a size")
        _within("fft_padding", self.fft_padding, 1, 10)
        _one_of("chan_mode", self.chan_mode, ("cube", "continuum"))

    @property
    def padded(self) -> int:
        return int(self.image_size * self.fft_padding)


@dataclass(frozen=True)
class WeightParams:
    weighting: str = "natural"
    robust: float = 0.5

    def __post_init__(self) -> None:
        _one_of("weighting", self.weighting, ("natural", "uniform", "briggs", "briggs_abs"))
        _within("robust", self.robust, -2, 2)


@dataclass(frozen=True)
class NormParams:
    norm_type: str = "flat_sky"
    pb_limit: float = 0.2
    single_precision: bool = True

    def __post_init__(self) -> None:
        _one_of("norm_type", self.norm_type, ("flat_noise", "flat_sky", "none"))
        _within("pb_limit", self.pb_limit, 0, 1)


@dataclass(frozen=True)
class DeconvolutionParams:
    gain: float = 0.1
    niter: int = 100
    threshold: float = 0.0

    def __post_init__(self) -> None:
        if not 0 < self.gain <= 1:
            raise ValueError("gain lies in (0, 1]")
        if self.niter < 1 or self.niter != int(self.niter):
            raise ValueError("niter is a positive whole number")
        _within("threshold", self.threshold, 0, float("inf"))


ROLES = ("correlated_data", "weight", "weight_imaging", "uvw", "flag")


@dataclass(frozen=True)
class DataGroups:
    """Named groups of roles, each played by one or more columns. Groups never change: ``derive`` gives new ones."""

    groups: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)

    def columns(self, group: str, role: str, df: DataFrame | None = None) -> tuple[str, ...]:
        """The columns of a role, which must be in ``df``."""
        if group not in self.groups:
            raise KeyError(f"no data group {group!r}; there are {sorted(self.groups)}")
        if role not in self.groups[group]:
            raise KeyError(f"the group {group!r} has no {role!r}; it has {sorted(self.groups[group])}")
        found = self.groups[group][role]
        if df is not None and (lost := [c for c in found if c not in df.columns]):
            raise KeyError(f"columns {lost} of {role!r} are not in the table")
        return found

    def derive(self, source: str, name: str, roles: dict[str, tuple[str, ...]], df: DataFrame, overwrite: bool = False) -> DataGroups:
        """A group ``name`` like ``source`` with other columns in some roles; an existing group or column is only written
        over where asked for. No other group goes away."""
        if unknown := set(roles) - set(ROLES):
            raise ValueError(f"unknown roles {sorted(unknown)}; known are {list(ROLES)}")
        if not overwrite:
            if name in self.groups:
                raise ValueError(f"the data group {name!r} exists")
            if taken := [c for columns in roles.values() for c in columns if c in df.columns]:
                raise ValueError(f"columns {taken} exist")
        return replace(self, groups={**self.groups, name: {**self.groups.get(source, {}), **roles}})


def standard(df: DataFrame, groups: DataGroups, group: str) -> DataFrame:
    """``df`` with the columns of a group under the names that the operators read: re, im, weight, u, v, w, flag."""
    names = {"correlated_data": ("re", "im"), "weight": ("weight",), "uvw": ("u", "v", "w"), "flag": ("flag",)}
    chosen: dict[str, Column] = {}
    for role, targets in names.items():
        if role in groups.groups.get(group, {}):
            found = groups.columns(group, role, df)
            if len(found) != len(targets):
                raise ValueError(f"{role!r} takes {len(targets)} columns")
            chosen |= {t: F.col(c) for t, c in zip(targets, found) if t != c}
    return df.withColumns(chosen) if chosen else df
