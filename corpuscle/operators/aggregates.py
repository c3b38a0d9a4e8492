"""Temperature and pressure, the thermostat, load statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.model import INFINITE, has_no


def thermo(rows: DataFrame, volume: float, velocity: tuple[str, str, str] = ("vx", "vy", "vz")) -> DataFrame:
    """n, temperature (sum of m v^2 over 3n - 3) and kinetic pressure; infinite rows don't count. One row; null below two rows."""
    vv = sum((F.col(v) * F.col(v) for v in velocity[1:]), F.col(velocity[0]) * F.col(velocity[0]))
    out = rows.where(has_no(INFINITE)).agg(F.count("*").alias("n"), F.sum(F.col("mass") * vv).alias("e"))
    free = F.when(F.col("n") > 1, 3.0 * F.col("n") - 3)
    return out.select("n", (F.col("e") / free).alias("temperature"), F.when(F.col("n") > 1, F.col("e") / (3 * volume)).alias("pressure"))


def thermostat(rows: DataFrame, target: float, velocity: tuple[str, str, str] = ("vx", "vy", "vz")) -> DataFrame:
    """Mean velocity to zero, then speeds scaled to the temperature. Infinite rows stay as they are.

    One aggregate gives all sums: with S = sum of v^2 about the mean. Its single row is broadcast.
    """
    on = has_no(INFINITE)
    used = rows.where(on)
    sums = used.agg(F.count("*").alias("_n"), *(F.avg(v).alias(f"_a{v}") for v in velocity), F.sum("mass").alias("_m"), *(F.sum(F.col("mass") * F.col(v)).alias(f"_p{v}") for v in velocity), F.sum(F.col("mass") * sum((F.col(v) * F.col(v) for v in velocity[1:]), F.col(velocity[0]) * F.col(velocity[0]))).alias("_e"))
    # sum m (v - a)^2 = sum m v^2 - 2 a sum m v + a^2 sum m
    e = F.col("_e")
    for v in velocity:
        e = e - 2 * F.col(f"_a{v}") * F.col(f"_p{v}") + F.col(f"_a{v}") * F.col(f"_a{v}") * F.col("_m")
    t = F.when(F.col("_n") > 1, e / (3.0 * F.col("_n") - 3))
    one = sums.select(*(f"_a{v}" for v in velocity), F.when(t > 0, F.sqrt(target / t)).otherwise(1.0).alias("_f"))
    out = rows.crossJoin(F.broadcast(one))  # one row
    return out.withColumns({v: F.when(on, (F.col(v) - F.col(f"_a{v}")) * F.col("_f")).otherwise(F.col(v)) for v in velocity}).drop("_f", *(f"_a{v}" for v in velocity))


def load_stats(rows: DataFrame, *block: str) -> DataFrame:
    """Least and greatest number of local rows, and of images, over the blocks that have rows."""
    ghost = F.col("is_ghost") if "is_ghost" in rows.columns else F.lit(False)
    per = rows.groupBy(*block).agg(F.sum((~ghost).cast("long")).alias("nlocal"), F.sum(ghost.cast("long")).alias("nghost"))
    return per.agg(*(f(c).alias(f"{n}_{c}") for c in ("nlocal", "nghost") for n, f in (("min", F.min), ("max", F.max))))


def timer_sums(timings: DataFrame) -> DataFrame:
    """(category, ms) of timings (name, ms): sums by the part of the name before the first underscore or colon."""
    return timings.groupBy(F.regexp_extract("name", "^[^_:]*", 0).alias("category")).agg(F.sum("ms").alias("ms"))
