"""Sinks: Parquet by step, and legacy VTK text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.model import INFINITE, has_no


def write_steps(rows: DataFrame, path: str, step: int) -> None:
    """One step into a table partitioned by step; a step written again replaces itself."""
    rows.withColumn("step", F.lit(step)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def vtk_due(step: int, every: int) -> bool:
    """VTK output has its own rule: every 0 means each step."""
    return every == 0 or step % every == 0


def write_vtk_step(rows: DataFrame, ghosts: DataFrame, prefix: str, step: int, position: str = "position", rank: int = 0) -> None:
    """Two files of a step, of the local rows and of the images: prefix_local_rank_step.vtk and prefix_ghost_rank_step.vtk."""
    write_vtk(rows, f"{prefix}_local_{rank}_{step}.vtk", position)
    write_vtk(ghosts, f"{prefix}_ghost_{rank}_{step}.vtk", position)


def write_vtk(rows: DataFrame, path: str, position: str = "position") -> None:
    """An ASCII VTK file of the points with their masses at 8 decimals, without infinite rows, in the order of uid.

    A report for viewers: rows come to the driver partition by partition. Large
    tables go to :func:`write_steps`.
    """
    part = rows.where(has_no(INFINITE)).select(F.col("uid"), *(F.col(f"{position}.{a}").alias(a) for a in "xyz"), "mass").orderBy("uid").persist()
    n = part.count()
    num = lambda v: f"{v:.8f}"
    with open(path, "w", encoding="ascii") as f:
        f.write(f"# vtk DataFile Version 2.0\nParticle data\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS {n} double\n")
        f.writelines(f"{num(r.x)} {num(r.y)} {num(r.z)}\n" for r in part.toLocalIterator())
        f.write(f"\n\nCELLS {n} {2 * n}\n")
        f.writelines(f"1 {k}\n" for k in range(n))
        f.write(f"\n\nCELL_TYPES {n}\n")
        f.writelines("1\n" for _ in range(n))
        f.write(f"\n\nPOINT_DATA {n}\nSCALARS mass double\nLOOKUP_TABLE default\n")
        f.writelines(f"{num(r.mass)}\n" for r in part.toLocalIterator())
    part.unpersist()
