"""Data model: domain, shapes, flags, and the declared schema of a particle table."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPHERE, HALFSPACE, POINT_MASS = 0, 1, 2
INFINITE, GHOST, FIXED, GLOBAL = 1, 2, 4, 8
#: The upper edge of a half-open subdomain is drawn in by this much.
EDGE = 1e-5

INT = T.IntegerType()
REAL = T.DoubleType()
VECTOR = T.StructType([T.StructField(x, REAL) for x in "xyz"])
MATRIX = T.StructType([T.StructField(f"m{k}", REAL) for k in range(9)])
QUATERNION = T.StructType([T.StructField(x, REAL) for x in "wxyz"])


def struct_of(kind: T.DataType, values: Any) -> Column:
    """A literal of a declared type: a number for INT and REAL, a sequence (or a number for all parts) for the others."""
    if not isinstance(kind, T.StructType):
        return F.lit(values).cast(kind)
    n = len(kind.fields)
    parts = list(values) if isinstance(values, (list, tuple)) else [values] * n
    if len(parts) != n:
        raise ValueError(f"{n} values are needed, not {len(parts)}")
    return F.struct(*(F.lit(float(v)).alias(f.name) for v, f in zip(parts, kind.fields, strict=True)))


@dataclass(frozen=True)
class Domain:
    """An axis-aligned box, and which of its axes are periodic."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]
    periodic: tuple[bool, bool, bool] = (True, True, True)

    @staticmethod
    def of(bounds: list[float], periodic: tuple[bool, bool, bool] = (True, True, True)) -> Domain:
        if len(bounds) != 6 or any(bounds[k] >= bounds[k + 3] for k in range(3)):
            raise ValueError("bounds are three lower ones, then three higher ones")
        return Domain(tuple(map(float, bounds[:3])), tuple(map(float, bounds[3:])), periodic)

    @property
    def lengths(self) -> tuple[float, float, float]:
        return tuple(h - l for l, h in zip(self.low, self.high, strict=True))

    @property
    def volume(self) -> float:
        a, b, c = self.lengths
        return a * b * c


@dataclass(frozen=True)
class Property:
    name: str
    kind: T.DataType
    default: Any = 0.0
    volatile: bool = False


@dataclass
class ParticleSchema:
    """What a simulation declares: properties, one of them the position; categories with lookup tables; contact properties."""

    properties: dict[str, Property] = field(default_factory=dict)
    position: str | None = None
    features: dict[str, int] = field(default_factory=dict)
    lookups: dict[str, tuple[str, list[float]]] = field(default_factory=dict)
    contacts: dict[str, Property] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, kind in (("uid", T.LongType()), ("shape", INT), ("flags", INT)):
            self.properties.setdefault(name, Property(name, kind, 0))

    def _new(self, name: str) -> None:
        if name in self.properties or name in self.lookups or name in self.contacts:
            raise ValueError(f"{name} is declared already")

    def add(self, name: str, kind: T.DataType, default: Any = 0.0, volatile: bool = False) -> None:
        self._new(name)
        self.properties[name] = Property(name, kind, default, volatile)

    def add_position(self, name: str = "position") -> None:
        if self.position:
            raise ValueError("there is a position already")
        self.add(name, VECTOR)
        self.position = name

    def add_feature(self, name: str, kinds: int) -> None:
        self.add(name, INT, 0)
        self.features[name] = kinds

    def add_lookup(self, feature: str, name: str, values: list[float]) -> None:
        self._new(name)
        if len(values) != self.features[feature] ** 2:
            raise ValueError(f"{name} needs a value for each pair of kinds")
        self.lookups[name] = (feature, [float(v) for v in values])

    def add_contact(self, name: str, kind: T.DataType, default: Any = 0.0) -> None:
        self._new(name)
        self.contacts[name] = Property(name, kind, default)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(p.name, p.kind) for p in self.properties.values()])

    def contact_struct(self) -> T.StructType:
        return T.StructType([T.StructField("uid_i", T.LongType()), T.StructField("uid_j", T.LongType()), *(T.StructField(p.name, p.kind) for p in self.contacts.values())])


def has_no(mask: int, flags: Column | str = "flags") -> Column:
    """Whether none of the mask's flags is set."""
    return (F.col(flags) if isinstance(flags, str) else flags).bitwiseAND(F.lit(mask)) == 0
