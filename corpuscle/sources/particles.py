"""Sources of particle tables: headerless CSV, lattices, and the domain line of a file."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.model import FIXED, GLOBAL, INFINITE, POINT_MASS, SPHERE, Domain, ParticleSchema, has_no, struct_of
from corpuscle.operators.grid import subdomain

MODULUS, MULTIPLIER = 2147483647, 16807


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], schema: ParticleSchema, shape: int, domain: Domain | None = None, edge: float = 0.0, first_uid: int = 0) -> DataFrame:
    """Particles of a headerless CSV file whose columns are given in order; a vector takes three fields, a matrix nine, a quaternion four.

    Columns that aren't in the file have their declared defaults, shape is the
    argument's. Without a uid column the lines are numbered from first_uid on
    (by partition, so not without gaps). A row stays if it lies in the domain or is
    infinite, fixed or global. A missing file raises an error.
    """
    fields: list[T.StructField] = []
    for c in columns:
        kind = schema.properties[c].kind
        fields += [T.StructField(f"{c}.{f.name}".replace(".", "__"), T.DoubleType()) for f in kind.fields] if isinstance(kind, T.StructType) else [T.StructField(c, kind)]
    raw = spark.read.schema(T.StructType(fields)).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    out = []
    for p in schema.properties.values():
        if p.name == "shape":
            value = F.lit(shape)
        elif p.name in columns:
            value = F.struct(*(F.col(f"{p.name}__{f.name}").alias(f.name) for f in p.kind.fields)) if isinstance(p.kind, T.StructType) else F.col(p.name)
        elif p.name == "uid":
            value = F.monotonically_increasing_id() + first_uid
        else:
            value = struct_of(p.kind, p.default)
        out.append(value.cast(p.kind).alias(p.name))
    rows = raw.select(*out)
    if domain and schema.position:
        pos = [F.col(f"{schema.position}.{a}") for a in "xyz"]
        rows = rows.where(subdomain(domain, pos, edge) | ~has_no(INFINITE | FIXED | GLOBAL))
    return rows


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(kind_i, kind_j, value) of a CSV file."""
    return spark.read.schema("kind_i int, kind_j int, value double").option("mode", "FAILFAST").csv(path)


def read_domain(spark: SparkSession, path: str) -> Domain:
    """The box in the first line of a file: three lower bounds, then three higher ones."""
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError("the file is empty")
    return Domain.of([float(x) for x in line[0].split(",")[:6]])


def lehmer(seed: Column, steps: int) -> Column:
    """The state of the multiplicative generator after a number of steps; the factors are folded into one literal."""
    return seed * F.lit(pow(MULTIPLIER, steps, MODULUS)) % F.lit(MODULUS)


def fcc_lattice(spark: SparkSession, cells: tuple[int, int, int], density: float, kinds: int = 1) -> tuple[DataFrame, Domain]:
    """Face-centred cubic sites with velocities by a per-site generator, flat: uid, type, mass, x, y, z, vx, vy, vz, flags, shape.

    Sites are those of a grid of half constants with an even sum of indices.
    Each velocity component is the generator's value, over its modulus, after 6, 12 and
    18 steps from the site's number. type is a hash of uid.
    """
    a = (4.0 / density) ** (1.0 / 3.0)
    nx, ny, nz = (2 * c for c in cells)
    n = F.col("id")
    ids = spark.range(nx * ny * nz).select(n, (n % nx).alias("i"), (F.floor(n / nx) % ny).alias("j"), F.floor(n / (nx * ny)).alias("k"))
    site = ids.where((F.col("i") + F.col("j") + F.col("k")) % 2 == 0)
    seed = F.col("k") * ny * nx + F.col("j") * nx + F.col("i") + 1
    rows = site.select(
        n.alias("uid"), F.pmod(F.xxhash64(n), F.lit(kinds)).cast("int").alias("type"), F.lit(1.0).alias("mass"),
        *((F.col(s) * (0.5 * a)).alias(x) for s, x in zip("ijk", "xyz", strict=True)),
        *((lehmer(seed, s) / float(MODULUS)).alias(v) for v, s in (("vx", 6), ("vy", 12), ("vz", 18))),
        F.lit(0).alias("flags"), F.lit(POINT_MASS).alias("shape"),
    )
    return rows, Domain.of([0.0, 0.0, 0.0, *(c * a for c in cells)])


def uniform(*keys: Column | int) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in keys)), F.lit(1 << 53)) / float(1 << 53)


def sc_grid(spark: SparkSession, size: tuple[float, float, float], spacing: float, diameter: float, least: float, most: float, speed: float, density: float, seed: int = 1) -> DataFrame:
    """Spheres on a simple cubic grid, flat: uid from 1 on (x fastest), x, y, z, radius, mass, vx, vy, vz, flags, shape.

    Points start half a spacing inside, along z at a diameter, and stay within
    the box. Diameters and sidewise speeds are random by uid.
    """
    counts = [max(0, math.ceil((hi - lo) / spacing - 1e-9)) for lo, hi in zip((0.5 * spacing, 0.5 * spacing, diameter), size, strict=True)]
    nx, ny, nz = counts
    n = F.col("id")
    rows = spark.range(nx * ny * nz).select((n + 1).alias("uid"), (0.5 * spacing + n % nx * spacing).alias("x"), (0.5 * spacing + F.floor(n / nx) % ny * spacing).alias("y"), (diameter + F.floor(n / (nx * ny)) * spacing).alias("z"))
    u = [uniform(F.col("uid"), seed, k) for k in range(3)]
    rows = rows.withColumn("radius", 0.5 * (least + u[0] * (most - least)))
    return rows.select("*", (4.0 / 3.0 * math.pi * density * F.pow("radius", F.lit(3.0))).alias("mass"), (0.1 * u[1]).alias("vx"), (0.1 * u[2]).alias("vy"), F.lit(-speed).alias("vz"), F.lit(0).alias("flags"), F.lit(SPHERE).alias("shape"))


def particle_lattice(spark: SparkSession, domain: Domain, spacing: tuple[float, float, float]) -> DataFrame:
    """uid, x, y, z of all points domain.low + spacing * index below domain.high."""
    counts = [max(0, math.ceil((hi - lo) / s - 1e-9)) for lo, hi, s in zip(domain.low, domain.high, spacing, strict=True)]
    nx, ny, nz = counts
    n = F.col("id")
    index = (n % nx, F.floor(n / nx) % ny, F.floor(n / (nx * ny)))
    return spark.range(nx * ny * nz).select(n.alias("uid"), *((lo + i * s).alias(a) for a, lo, i, s in zip("xyz", domain.low, index, spacing, strict=True)))


def nested(flat: DataFrame, schema: ParticleSchema, vectors: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Declared columns from flat ones: vectors names the three columns of each vector; what is missing has its default."""
    out = []
    for p in schema.properties.values():
        if p.name in vectors:
            value = F.struct(*(F.col(c).alias(a) for a, c in zip("xyz", vectors[p.name], strict=True)))
        else:
            value = F.col(p.name) if p.name in flat.columns else struct_of(p.kind, p.default)
        out.append(value.cast(p.kind).alias(p.name))
    return flat.select(*out)
