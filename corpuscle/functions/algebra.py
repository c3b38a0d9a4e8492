"""Vectors, 3x3 matrices and quaternions as expressions over struct columns; scalar helpers of the kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

Scalar = Union[Column, int, float]


def col(x: Scalar | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def safe_div(a: Scalar, b: Scalar, fallback: Scalar = 0.0) -> Column:
    """a / b, and fallback where b is 0 (which ANSI mode would refuse)."""
    return F.when(col(b) != 0, col(a) / col(b)).otherwise(col(fallback))


def int_div(a: Scalar, b: Scalar) -> Column:
    """Division of whole numbers, towards zero."""
    q = F.floor(F.abs(col(a)) / F.abs(col(b))).cast("long")
    return F.when((col(a) < 0) != (col(b) < 0), -q).otherwise(q)


def remainder(a: Scalar, b: Scalar) -> Column:
    """With the sign of a."""
    return col(a) % col(b)


def smallest(*xs: Scalar) -> Column:
    """Folds with <: a NaN never replaces what was found before."""
    return reduce(lambda a, b: F.when(_less(b, a), b).otherwise(a), map(col, xs))


def largest(*xs: Scalar) -> Column:
    return reduce(lambda a, b: F.when(_less(a, b) & ~F.isnan(b), b).otherwise(a), [col(x).cast("double") for x in xs])


def _less(a: Column, b: Column) -> Column:
    """IEEE <; Spark holds NaN to be the largest value."""
    return (a < b) & ~F.isnan(b.cast("double"))


def select(cond: Column, a, b):
    """a where cond holds, else b: scalars, or two vectors, matrices or quaternions."""
    if isinstance(a, Parts):
        return type(a)(*(F.when(cond, x).otherwise(y) for x, y in zip(a.parts, b.parts, strict=True)))
    return F.when(cond, col(a)).otherwise(col(b))


def truncate(x: Scalar, kind: str = "int") -> Column:
    return col(x).cast(kind)


class Parts:
    """Common to the types of several parts."""

    names: tuple[str, ...] = ()

    def __init__(self, *parts: Scalar) -> None:
        if len(parts) != len(self.names):
            raise ValueError(f"{len(self.names)} parts are needed")
        self.parts = tuple(map(col, parts))

    @classmethod
    def of(cls, struct: Column | str):
        s = col(struct)
        return cls(*(s[n] for n in cls.names))

    @classmethod
    def fill(cls, x: Scalar):
        return cls(*[x] * len(cls.names))

    def struct(self) -> Column:
        return F.struct(*(p.cast("double").alias(n) for p, n in zip(self.parts, self.names, strict=True)))

    def flat(self, prefix: str, last: Callable[[Column], Column] = lambda c: c) -> list[Column]:
        return [last(p).alias(f"{prefix}_{n}") for p, n in zip(self.parts, self.names, strict=True)]

    def __getitem__(self, k: int) -> Column:
        return self.parts[k]

    def _with(self, other, op) :
        others = other.parts if isinstance(other, Parts) else [col(other)] * len(self.parts)
        return type(self)(*(op(a, b) for a, b in zip(self.parts, others, strict=True)))

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b)

    def __neg__(self):
        return type(self)(*(-p for p in self.parts))

    def with_part(self, k: int, x: Scalar):
        return type(self)(*(col(x) if i == k else p for i, p in enumerate(self.parts)))

    def squared_length(self) -> Column:
        return reduce(lambda a, b: a + b, (p * p for p in self.parts))

    def length(self) -> Column:
        return F.sqrt(self.squared_length())


class Vec(Parts):
    names = ("x", "y", "z")

    @property
    def x(self) -> Column:
        return self.parts[0]

    @property
    def y(self) -> Column:
        return self.parts[1]

    @property
    def z(self) -> Column:
        return self.parts[2]

    def __mul__(self, other):
        """By part with a vector or a scalar; with a matrix M, its rows times the vector (M v)."""
        if isinstance(other, Mat):
            return other.times(self)
        return self._with(other, lambda a, b: a * b)

    __rmul__ = __mul__

    def __truediv__(self, other):
        return self._with(other, lambda a, b: safe_div(a, b))

    def dot(self, other: Vec) -> Column:
        return self.x * other.x + self.y * other.y + self.z * other.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def normalized(self) -> Vec:
        """Zero stays zero."""
        n = self.length()
        return Vec(*(F.when(n > 0, safe_div(p, n)).otherwise(F.lit(0.0)) for p in self.parts))


def zero_vector() -> Vec:
    return Vec(0.0, 0.0, 0.0)


class Mat(Parts):
    """Row-major."""

    names = tuple(f"m{k}" for k in range(9))

    @staticmethod
    def diagonal(x: Scalar) -> Mat:
        return Mat(*(col(x) if k % 4 == 0 else F.lit(0.0) for k in range(9)))

    def transposed(self) -> Mat:
        return Mat(*(self.parts[k % 3 * 3 + k // 3] for k in range(9)))

    def determinant(self) -> Column:
        a, b, c, d, e, f, g, h, i = self.parts
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    def inversed(self) -> Mat:
        """Adjugate over determinant; a singular matrix gives zeros."""
        a, b, c, d, e, f, g, h, i = self.parts
        det = self.determinant()
        adj = (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)
        return Mat(*(safe_div(x, det) for x in adj))

    def times(self, v: Vec) -> Vec:
        m = self.parts
        return Vec(*(m[3 * r] * v.x + m[3 * r + 1] * v.y + m[3 * r + 2] * v.z for r in range(3)))

    def __mul__(self, other):
        if isinstance(other, Vec):
            return self.times(other)
        if isinstance(other, Mat):
            m, n = self.parts, other.parts
            return Mat(*(m[3 * r] * n[c] + m[3 * r + 1] * n[3 + c] + m[3 * r + 2] * n[6 + c] for r in range(3) for c in range(3)))
        return self._with(other, lambda a, b: a * b)

    def __rmul__(self, other):
        return self * other


class Quat(Parts):
    names = ("w", "x", "y", "z")

    @staticmethod
    def identity() -> Quat:
        return Quat(1.0, 0.0, 0.0, 0.0)

    @staticmethod
    def rotation(axis: Vec, angle: Scalar) -> Quat:
        """Half-angle form; the identity for an axis shorter than 1e-6."""
        n, half = axis.length(), 0.5 * col(angle)
        ok = n >= 1e-6
        s = F.sin(half)
        return Quat(F.when(ok, F.cos(half)).otherwise(1.0), *(F.when(ok, s * safe_div(p, n)).otherwise(0.0) for p in axis.parts))

    def __mul__(self, o: Quat) -> Quat:
        """Hamilton product, to length 1 again where it strays by 1e-8 or more."""
        if not isinstance(o, Quat):
            raise TypeError("a quaternion is multiplied by a quaternion")
        a, b, c, d = self.parts
        e, f, g, h = o.parts
        q = Quat(a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)
        n = q.squared_length()
        return Quat(*(F.when(F.abs(n - 1) < 1e-8, p).otherwise(safe_div(p, F.sqrt(n))) for p in q.parts))

    def matrix(self) -> Mat:
        w, x, y, z = self.parts
        return Mat(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))


def wrapper(names: Iterable[str]):
    """The class whose struct has these fields, or None."""
    return {k.names: k for k in (Vec, Mat, Quat)}.get(tuple(names))
