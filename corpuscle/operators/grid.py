"""Spatial bins: cells, occupancy, and range joins as equi-joins on cells.

A range join sends each left row to the cells that its range reaches and meets
the right rows of equal cell keys; an exact test follows. Cells are two ranges
wide (eight are reached at most), or narrower where they would be crowded.
Catalyst sees an equi-join, which it sorts, so that the rows of a cell lie
together, and can split skewed keys of; a theta join would be a Cartesian product.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.model import INFINITE, Domain

AXES = ("x", "y", "z")


def subdomain(domain: Domain, pos: Sequence[Column], edge: float) -> Column:
    """Half-open box test; the upper faces are drawn in by edge."""
    inside = F.lit(True)
    for p, lo, hi in zip(pos, domain.low, domain.high, strict=True):
        inside = inside & (p >= lo) & (p < hi - edge)
    return inside


def stencil_cells(domain: Domain, spacing: float) -> tuple[list[int], int]:
    """Cells by axis, with a margin of one spacing, and their number with the extra cell 0."""
    dims = [math.ceil((n + 2 * spacing) / spacing) + 1 for n in domain.lengths]
    return dims, math.prod(dims) + 1


def stencil(spark, domain: Domain, spacing: float, cutoff: float | None = None) -> DataFrame:
    """(dx, dy, dz, offset): displacements to the cells within cutoff, and in the flat numbering."""
    dims, _ = stencil_cells(domain, spacing)
    n = math.ceil((cutoff or spacing) / spacing - 1e-12)
    w = 2 * n + 1
    k = F.col("id")
    out = spark.range(w**3).select((F.floor(k / (w * w)) - n).cast("int").alias("dx"), (F.floor(k / w) % w - n).cast("int").alias("dy"), (k % w - n).cast("int").alias("dz"))
    return out.withColumn("offset", ((F.col("dx") * dims[1] + F.col("dy")) * dims[2] + F.col("dz")).cast("int"))


def flat_cell(domain: Domain, spacing: float, pos: Sequence[Column], flags: Column) -> Column:
    """Flat cell number from 1 on, clamped to the grid; 0 for infinite rows."""
    dims, _ = stencil_cells(domain, spacing)
    c = [F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((p - F.lit(lo - spacing)) / spacing).cast("int"))) for p, lo, n in zip(pos, domain.low, dims, strict=True)]
    return F.when(flags.bitwiseAND(F.lit(INFINITE)) != 0, F.lit(0)).otherwise((c[0] * dims[1] + c[1]) * dims[2] + c[2] + 1).cast("int")


#: Cells beyond this count from the origin are one: where coordinates lie so far apart, no two of them are in range. It leaves room for neighbours in a long.
FAR = 1 << 62


def bins(pos: Sequence[Column], size: float) -> list[Column]:
    return [F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.floor(p / size).cast("long"))) for p in pos]


#: Cells of a range join are WIDTH ranges wide. Above 2 a range reaches two cells of an axis at most: a left row travels
#: to 6.9 cells on average, where cells of one range would take 20.6 for a third of the exact tests; shuffling costs more than testing.
WIDTH = 2.0001
#: Cells that a range misses by less than this share of a cell count as reached, as coordinates are rounded.
MARGIN = 1e-6


def reached(pos: Sequence[str], size: float, width: float) -> Column:
    """The cells, wider than 2 * size, that hold a point within size of pos: an array of eight structs x, y, z, null where the range falls short."""
    if width <= 2 * size:
        raise ValueError("a range may reach two cells of an axis at most")
    choices: list[list[tuple[Column, Column]]] = []  # by axis: cell, and squared distance to it, for the own one and the near neighbour
    for p in map(F.col, pos):
        own = bins([p], width)[0]
        part = p / width - own
        left = part < 0.5
        gap = F.when(left, part).otherwise(1.0 - part) - MARGIN
        gap = F.greatest(gap, F.lit(0.0))
        choices.append([(own, F.lit(0.0)), (F.when(left, own - 1).otherwise(own + 1), gap * gap)])
    limit = (size / width) ** 2
    cells = []
    for (x, dx), (y, dy), (z, dz) in itertools.product(*choices):
        cells.append(F.when(dx + dy + dz <= limit, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), z.cast("long").alias("z"))))
    return F.array(*cells)


#: Widths of cells in ranges. Narrow ones cost more copies of left rows and spare tests: 13.1, 4.9 and 2.5 for a couple in range.
WIDTHS = (WIDTH, 1.0, 0.5)
#: A copy of a left row costs about as much as so many exact tests.
TRAVEL = 40.0


def crowd(right: DataFrame, pos: Sequence[str], size: float) -> tuple[float, float]:
    """The number of right rows, and how many of them a row has in its cell of the widest kind, on average; all rows are counted."""
    cells = right.groupBy(*bins([F.col(p) for p in pos], WIDTH * size)).agg(F.count("*").cast("double").alias("n"))
    n, squares = cells.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    return n or 0.0, (squares or 0.0) / (n or 1.0)


def fitting_width(right: DataFrame, pos: Sequence[str], size: float) -> float:
    """The width, in ranges, that costs least."""
    return width_for(crowd(right, pos, size)[1])


def width_for(n: float) -> float:
    copies = lambda w: 1 + 6 / w + 3 * math.pi / w**2 + 4 / 3 * math.pi / w**3
    return min(WIDTHS, key=lambda w: copies(w) * (TRAVEL + n * (w / WIDTH) ** 3))


def sent(rows: DataFrame, pos: Sequence[str], size: float, width: float) -> DataFrame:
    """rows, each with the keys _cx.. of every cell, width wide, that holds a point within size of it."""
    if width > 2 * size:
        l = rows.select("*", F.explode(reached(pos, size, width)).alias("_c")).where("_c is not null")
        return l.select(*rows.columns, *(F.col(f"_c.{a}").alias(f"_c{a}") for a in AXES))
    m = math.ceil(size / width) + 1
    l = rows.select("*", *(c.alias(f"_c{a}") for a, c in zip(AXES, bins([F.col(p) for p in pos], width), strict=True)), F.lit(0.0).alias("_gone"))
    for a, p in zip(AXES, pos, strict=True):  # axis by axis, so that what is out of range goes early
        l = l.withColumn("_o", F.explode(F.array(*map(F.lit, range(-m, m + 1)))))
        part, o = F.col(p) / width - F.col(f"_c{a}"), F.col("_o")
        gap = F.greatest(F.when(o > 0, o - part).when(o < 0, part - o - 1.0).otherwise(0.0) - MARGIN, F.lit(0.0))
        l = l.withColumns({"_gone": F.col("_gone") + gap * gap, f"_c{a}": F.col(f"_c{a}") + o}).where(F.col("_gone") <= (size / width) ** 2)
    return l.drop("_o", "_gone")


def range_join(left: DataFrame, right: DataFrame, pos_i: Sequence[str], pos_j: Sequence[str], size: float, test: Column, salt: int = 1, salt_by: str | None = None, width: float | None = None) -> DataFrame:
    """Rows of left and right (no common column names) within size of each other that pass test.

    size is at least the largest distance that can pass. Cells are width ranges wide, as :func:`fitting_width` says if
    it isn't given. Crowded cells of the widest kind can be split: with salt > 1 the right rows of a cell are dealt
    into salt parts by hash of salt_by, and each left row meets all parts. Rows with a null coordinate meet none.
    """
    if size <= 0:
        raise ValueError("the range must be positive")
    width = width or fitting_width(right, pos_j, size)
    l = sent(left, pos_i, size, width * size)
    r = right.select("*", *(b.alias(f"_c{a}") for b, a in zip(bins([F.col(p) for p in pos_j], width * size), AXES, strict=True)))
    keys = [f"_c{a}" for a in AXES]
    if salt > 1 and width > 2:
        r = r.withColumn("_salt", F.pmod(F.xxhash64(salt_by or pos_j[0]), F.lit(salt)))
        l = l.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        keys.append("_salt")
    return l.join(r.hint("merge"), keys).where(test).drop(*keys)


def cell_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))
