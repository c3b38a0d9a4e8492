"""Kernels: Python functions over proxies that become column expressions.

A row kernel takes one proxy; each assignment is one projection, so that a read
after a write sees the new value. A pair kernel takes a context of an
interaction join; its steps are recorded in order: filters, first access to the
contact state, bindings, sums. Nothing runs in Python on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions.algebra import Parts, Vec, col, select, wrapper
from corpuscle.model import FIXED, HALFSPACE, POINT_MASS, SPHERE, ParticleSchema, has_no
from corpuscle.operators import contacts, interactions


def read(df: DataFrame, name: str):
    """A column, in its algebra class if it is a struct of one."""
    kind = df.schema[name].dataType
    cls = wrapper(f.name for f in kind.fields) if isinstance(kind, T.StructType) else None
    return cls.of(F.col(name)) if cls else F.col(name)


def bind(df: DataFrame, name: str, value: Any) -> tuple[DataFrame, Any]:
    """df with a value as columns of its own, one for each part, and the value read from them.

    Parts stay apart, because the optimizer would put the expression of a
    struct's field into each place that reads it, and expressions would grow with
    every step.
    """
    if not isinstance(value, Parts):
        return df.withColumn(name, col(value)), F.col(name)
    cols = {f"{name}_{n}": p for n, p in zip(value.names, value.parts, strict=True)}
    return df.withColumns(cols), type(value)(*map(F.col, cols))


class Row:
    """The proxy of a row kernel: row[name] reads, row[name] = value assigns (a scalar fills all parts of a vector)."""

    def __init__(self, df: DataFrame, where: Column | None = None) -> None:
        self.df, self.where, self.start = df, where, df.columns
        self.now: dict[str, Any] = {}
        self.n = 0

    def __getitem__(self, name: str):
        return self.now[name] if name in self.now else read(self.df, name)

    def __setitem__(self, name: str, value: Any) -> None:
        old = self[name]
        if isinstance(old, Parts):
            value = value if isinstance(value, Parts) else type(old).fill(value)
            if type(value) is not type(old):
                raise TypeError(f"{name} is a {type(old).__name__}")
            new = value if self.where is None else select(self.where, value, old)
            self.n += 1
            self.df, self.now[name] = bind(self.df, f"_set{self.n}_{name}", new)
        else:
            if isinstance(value, Parts):
                raise TypeError(f"{name} is a scalar")
            new = col(value).cast(self.df.schema[name].dataType)
            self.df = self.df.withColumn(name, new if self.where is None else F.when(self.where, new).otherwise(F.col(name)))

    def let(self, name: str, value: Any):
        """Binds a value to columns of its own, which are dropped at the end."""
        self.df, value = bind(self.df, f"_let_{name}", value)
        return value

    def done(self) -> DataFrame:
        return self.df.select(*(self.now[c].struct().alias(c) if c in self.now else F.col(c) for c in self.start))

    def is_shape(self, shape: int) -> Column:
        return F.col("shape") == shape


def run_row(df: DataFrame, kernel: Callable, symbols: dict[str, Any] | None = None, fixed_too: bool = False) -> DataFrame:
    """df after a row kernel; fixed rows stay as they are, unless fixed_too (setup kernels)."""
    row = Row(df, None if fixed_too else has_no(FIXED))
    kernel(row, **(symbols or {}))
    return row.done()


class Side:
    def __init__(self, pair: Pair, tag: str) -> None:
        self.pair, self.tag = pair, tag

    def __getitem__(self, name: str):
        return read(self.pair.df, f"{name}_{self.tag}")


class Pair:
    """The context of a pair kernel for one shape of the right side."""

    def __init__(self, df: DataFrame, shape: int, schema: ParticleSchema, state: DataFrame | None, half: bool) -> None:
        self.df, self.shape, self.schema, self.state, self.half = df, shape, schema, state, half
        self.i, self.j = Side(self, "i"), Side(self, "j")
        self.touched = False
        self.sums: dict[str, list[tuple[Parts | Column, Parts | Column]]] = {}
        self.n = 0

    def _vec(self, prefix: str) -> Vec:
        return Vec(*(F.col(f"{prefix}{a}") for a in "xyz"))

    @property
    def delta(self) -> Vec:
        if self.shape == HALFSPACE:
            raise ValueError("a half-space has no distance vector")
        return self._vec("d")

    @property
    def squared_distance(self) -> Column:
        if self.shape == HALFSPACE:
            raise ValueError("a half-space has no distance")
        return F.col("rsq")

    def _contact(self) -> None:
        if self.shape == POINT_MASS:
            raise ValueError("point masses have no contact geometry")

    @property
    def penetration_depth(self) -> Column:
        self._contact()
        return F.col("depth")

    @property
    def contact_normal(self) -> Vec:
        self._contact()
        return self._vec("normal_")

    @property
    def contact_point(self) -> Vec:
        self._contact()
        return self._vec("point_")

    def lookup(self, name: str) -> Column:
        feature, values = self.schema.lookups[name]
        return interactions.lookup(self.df, self.schema.features[feature], values, f"{feature}_i", f"{feature}_j")

    def skip_when(self, cond: Column) -> None:
        """Drops couples; those dropped before the first access to the contact state aren't touched."""
        self.df = self.df.where(~cond)

    def let(self, name: str, value: Any):
        """Binds a value to columns, so that later steps don't repeat its expression."""
        self.df, value = bind(self.df, f"_let_{name}", value)
        return value

    def _touch(self) -> None:
        if not self.touched:
            if self.state is None:
                raise ValueError("the simulation keeps no contact history")
            self.df = contacts.touch_declared(self.df, self.state, self.schema)
            self.touched = True

    def contact(self, name: str):
        self._touch()
        return read(self.df, name)

    def set_contact(self, name: str, value: Any) -> None:
        self._touch()
        self.df = self.df.withColumn(name, value.struct() if isinstance(value, Parts) else col(value).cast(self.df.schema[name].dataType))

    def apply(self, name: str, value) -> None:
        """Adds the sum of value over partners to a property of i (in half mode also subtracts it from j's).

        value is an expression, or a function of the receiving side.
        """
        at_i, at_j = (value(self.i), value(self.j)) if callable(value) else (value, value)
        self.sums.setdefault(name, []).append((at_i, at_j))

    def result(self) -> DataFrame | None:
        """uid and sums as columns name (scalars) or name.part, partly aggregated by row."""
        if not self.sums:
            return None

        def flat(which: int) -> list[Column]:
            out = []
            for name, values in self.sums.items():
                total = values[0][which]
                for v in values[1:]:
                    total = total + v[which]
                out += [p.alias(f"{name}__{n}") for p, n in zip(total.parts, total.names, strict=True)] if isinstance(total, Parts) else [total.alias(f"{name}__")]
            return out

        rows = self.df.select(F.col("uid_i").alias("uid"), *flat(0))
        if self.half and self.shape != HALFSPACE:
            hit = self.df.where(has_no(FIXED, "flags_j"))
            if "is_ghost_j" in self.df.columns:
                hit = hit.where(~F.col("is_ghost_j"))
            other = hit.select(F.col("uid_j").alias("uid"), *flat(1))
            rows = rows.unionByName(other.select("uid", *((-F.col(c)).alias(c) for c in other.columns[1:])))
        return rows


def run_pair(df: DataFrame, right: DataFrame, kernel: Callable, schema: ParticleSchema, shapes: list[int], cutoff: float | None, symbols: dict[str, Any] | None = None, state: DataFrame | None = None, half: bool = False, max_radius: float | None = None, stored: dict[int, DataFrame] | None = None, lengths: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[DataFrame, DataFrame | None]:
    """(df after a pair kernel, the contact state after it: None if the kernel didn't touch it).

    df is the local rows and right these with their images; both nested as
    declared. stored are candidates by shape of the right side, which save its range join.
    """
    names = [p for p in schema.properties if p not in ("uid", "flags", "shape")]
    place = [F.col(f"{schema.position}.{a}").alias(a) for a in "xyz"]
    normal = [F.col(f"normal.{a}").alias(f"normal_{a}") for a in "xyz"] if "normal" in schema.properties else []
    left, other = df.select("*", *place, *normal), right.select("*", *place, *normal)
    joined = {}
    for shape, couples in (stored or {}).items():
        if shape == POINT_MASS:
            met = interactions.from_candidates(left, couples, cutoff, lengths, [*names, "flags"], names)
        else:
            met = interactions.spheres_from_candidates(left, couples, lengths, [*names, "flags"], names)
        joined[shape] = met.where(F.col("is_ghost_j") | (F.col("uid_i") < F.col("uid_j"))) if half else met
    if rest := [x for x in shapes if x not in joined]:
        joined |= interactions.interactions(left, cutoff, rest, other, [*names, "flags"], names, half, max_radius)
    parts, states = [], []
    for shape, couples in joined.items():
        pair = Pair(couples, shape, schema, state, half)
        kernel(pair, **(symbols or {}))
        if (rows := pair.result()) is not None:
            parts.append(rows)
        if pair.touched:
            states.append(contacts.pruned(pair.df, list(schema.contacts), "is_ghost_j" not in couples.columns))
    out = df
    if parts:
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        sums = rows.groupBy("uid").agg(*(F.sum(c).alias(c) for c in rows.columns[1:]))
        out = df.join(sums, "uid", "left")
        for name in dict.fromkeys(c.split("__")[0] for c in rows.columns[1:]):
            old = read(df, name)
            if isinstance(old, Parts):
                new = type(old)(*(p + F.coalesce(F.col(f"{name}__{n}"), F.lit(0.0)) for p, n in zip(old.parts, old.names, strict=True))).struct()
            else:
                new = old + F.coalesce(F.col(f"{name}__"), F.lit(0.0))
            out = out.withColumn(name, new)
        out = out.select(*df.columns)
    after = None
    if states:
        after = states[0]
        for s in states[1:]:
            after = after.unionByName(s)
        if any("is_ghost_j" in c.columns for c in joined.values()):
            after = after.dropDuplicates(contacts.KEY)
    return out, after


__all__ = ["Pair", "Row", "run_pair", "run_row", "SPHERE", "POINT_MASS", "HALFSPACE"]
