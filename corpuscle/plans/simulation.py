"""The declarative simulation: what is declared, in which order a step runs its stages, and the step loop."""

from __future__ import annotations

import atexit
import inspect
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.model import HALFSPACE, POINT_MASS, SPHERE, Domain, ParticleSchema, struct_of
from corpuscle.operators import aggregates, contacts, images, interactions
from corpuscle.operators.kernels import run_pair, run_row
from corpuscle.sources import particles, sinks


def due(step: int, every: int) -> bool:
    """The rule of all periods but VTK's."""
    return step == 0 or (step + 1) % every == 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves in local mode only, where driver and executors are one process.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="corpuscle-steps-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """This session's folder for steps; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        root = _roots[app] = f"{shared_folder(spark).rstrip('/')}/steps-{uuid.uuid4().hex}"

        def clean() -> None:
            try:
                _delete(spark, root)
            except Exception:  # the session may have ended first
                pass

        atexit.register(clean)
    return _roots[app]


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: written to the shared folder, so that a lost executor loses nothing of it."""
    path = f"{_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of :func:`cut` that a later one has replaced."""
    for t in tables:
        if path := getattr(t, "_cut_path", None):
            _delete(t.sparkSession, path)


class Array:
    """A declared array as kernels see it: array[index] is an expression."""

    def __init__(self, values: Sequence[float]) -> None:
        self.column = F.array(*(F.lit(float(v)) for v in values))

    def __getitem__(self, index):
        return F.get(self.column, index if not isinstance(index, int) else F.lit(index))


@dataclass(frozen=True)
class Stage:
    name: str
    kernel: Callable
    pair: bool
    cutoff: float | None
    symbols: dict[str, Any]
    skip_first: bool


class Simulation:
    """Declare, then run: each step is one query over the particles, cut off from the last."""

    def __init__(self, spark: SparkSession, shapes: Sequence[int], timesteps: int = 100, use_contact_history: bool = False) -> None:
        self.spark, self.shapes, self.timesteps = spark, list(shapes), timesteps
        self.schema = ParticleSchema()
        self.history = use_contact_history
        self.periodic = (True, True, True)
        self.domain: Domain | None = None
        self.partitioner: tuple[int, tuple[bool, bool, bool]] | None = None
        self.period, self.half, self.halo = 1, False, None
        self.thermo_every, self.vtk = 0, None
        self.listed, self.per_cell, self.lists = False, False, None
        self.visible: dict[str, Any] = {}
        self.used: list[DataFrame] = []
        self.before: list[Stage] = []
        self.stages: list[Stage] = []
        self.setups: list[tuple[Callable, dict[str, Any]]] = []
        self.tables: list[DataFrame] = []
        self.names: set[str] = set()
        self.profile = False
        self.timings: list[tuple[int, str, float]] = []
        self.thermo_rows: list[tuple[int, float, float]] = []
        self.particles: DataFrame | None = None
        self.state: DataFrame | None = None

    # declarations
    def add_property(self, name: str, kind: T.DataType, value: Any = 0.0, volatile: bool = False) -> None:
        self.schema.add(name, kind, value, volatile)

    def add_position(self, name: str = "position") -> None:
        self.schema.add_position(name)

    def add_feature(self, name: str, kinds: int) -> None:
        self.schema.add_feature(name, kinds)

    def add_feature_property(self, feature: str, name: str, values: list[float]) -> None:
        self.schema.add_lookup(feature, name, values)

    def add_contact_property(self, name: str, kind: T.DataType, default: Any = 0.0) -> None:
        self.schema.add_contact(name, kind, default)

    def add_var(self, name: str, value: Any) -> None:
        """A scalar that any kernel with a parameter of that name gets; a later call changes it for the steps to come."""
        self.visible[name] = value

    add_symbol = add_temp_var = add_var

    def add_static_array(self, name: str, values: Sequence[float]) -> None:
        """An array of the driver that any kernel with a parameter of that name gets; it is a literal of the plan."""
        self.visible[name] = Array(values)

    add_array = add_static_array

    def _symbols(self, kernel: Callable, given: dict[str, Any]) -> dict[str, Any]:
        wanted = inspect.signature(kernel).parameters
        return {k: v for k, v in self.visible.items() if k in wanted} | given

    def set_domain(self, bounds: list[float]) -> None:
        self.domain = Domain.of(bounds, self.periodic)

    def pbc(self, axes: Sequence[bool]) -> None:
        self.periodic = tuple(axes)
        if self.domain:
            self.domain = Domain(self.domain.low, self.domain.high, self.periodic)

    def set_domain_partitioner(self, blocks: int, axes: tuple[bool, bool, bool] = (True, True, True)) -> None:
        """Rows are dealt out by block at each rebuild; axes (True, True, False) splits x and y only."""
        self.partitioner = (blocks, axes)

    def reneighbor_every(self, n: int) -> None:
        if n < 1:
            raise ValueError("the period is at least 1")
        self.period = n

    def build_cell_lists(self, spacing: float, store_neighbors_per_cell: bool = False) -> None:
        """spacing is the width of the halo; bins of joins have the size of the largest range.

        With store_neighbors_per_cell, the rows around each cell are stored as its list, which the rows inside read until the next rebuild.
        """
        self.halo, self.listed, self.per_cell = spacing, store_neighbors_per_cell, store_neighbors_per_cell

    def build_neighbor_lists(self, spacing: float) -> None:
        """Candidates within spacing (range and skin) are stored, and serve until the next rebuild or until a row has moved by half the skin.

        They are kept for point masses and spheres; half-spaces are joined anew in each step.
        """
        self.halo, self.listed, self.per_cell = spacing, True, False

    def _stored(self, rows: DataFrame, reach: float, step: int) -> dict[int, DataFrame]:
        """Candidates by shape of the right side; reach is the largest range, without the skin."""
        flat = rows.select("uid", "flags", "shape", *(F.col(f"{self.schema.position}.{a}").alias(a) for a in "xyz"))
        if self.lists is None or due(step, self.period) or interactions.moved(flat, self.lists[1]) > (self.halo - reach) / 2:
            if self.lists:
                self.used += [*self.lists[0].values(), self.lists[1]]
            flat = cut(flat)
            near, left = images.images(flat, self.domain, self.halo), flat.where(F.col("shape") != HALFSPACE)
            build = interactions.cell_couples if self.per_cell else interactions.candidates
            self.lists = ({x: cut(build(left, near.where(F.col("shape") == x), self.halo)) for x in self.shapes if x != HALFSPACE}, flat)
        return self.lists[0]

    def compute_half(self) -> None:
        self.half = True

    def compute_thermo(self, every: int = 0) -> None:
        self.thermo_every = every

    def vtk_output(self, path: str, frequency: int = 0) -> None:
        self.vtk = (path, frequency)

    def enable_profiler(self) -> None:
        self.profile = True

    def compute(self, kernel: Callable, cutoff: float | None = None, symbols: dict[str, Any] | None = None, pre_step: bool = False, skip_first: bool = False, pair: bool | None = None) -> None:
        """A row kernel, or a pair kernel if cutoff is given or pair is set."""
        if kernel.__name__ in self.names:
            raise ValueError(f"there is a kernel {kernel.__name__} already")
        self.names.add(kernel.__name__)
        stage = Stage(kernel.__name__, kernel, cutoff is not None if pair is None else pair, cutoff, symbols or {}, skip_first)
        (self.before if pre_step else self.stages).append(stage)

    def setup(self, kernel: Callable, symbols: dict[str, Any] | None = None) -> None:
        self.setups.append((kernel, symbols or {}))

    # sources
    def add_rows(self, rows: DataFrame, vectors: dict[str, tuple[str, str, str]] | None = None) -> None:
        """Rows of any table; flat columns named in vectors are put together."""
        self.tables.append(particles.nested(rows, self.schema, vectors or {}))

    def read_particle_data(self, path: str, columns: Sequence[str], shape: int) -> None:
        self.tables.append(particles.read_csv(self.spark, path, columns, self.schema, shape, self.domain, first_uid=len(self.tables) << 48))

    def copper_fcc_lattice(self, cells: tuple[int, int, int], density: float, temperature: float, kinds: int = 1) -> None:
        """Sets the domain, too."""
        rows, box = particles.fcc_lattice(self.spark, cells, density, kinds)
        self.domain = Domain(box.low, box.high, self.periodic)
        self.add_rows(aggregates.thermostat(rows, temperature), {self.schema.position: ("x", "y", "z"), "linear_velocity": ("vx", "vy", "vz")})

    def dem_sc_grid(self, size: tuple[float, float, float], spacing: float, diameter: float, least: float, most: float, speed: float, density: float) -> None:
        self.add_rows(particles.sc_grid(self.spark, size, spacing, diameter, least, most, speed, density), {self.schema.position: ("x", "y", "z"), "linear_velocity": ("vx", "vy", "vz")})

    def create_particle_lattice(self, spacing: tuple[float, float, float], shape: int = POINT_MASS) -> None:
        self.add_rows(particles.particle_lattice(self.spark, self.domain, spacing).withColumn("shape", F.lit(shape)), {self.schema.position: ("x", "y", "z")})

    # running
    def initial(self) -> DataFrame:
        if not self.tables or self.domain is None or not self.schema.position:
            raise ValueError("particles, a domain and a position are needed")
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        for kernel, symbols in self.setups:
            out = run_row(out, kernel, self._symbols(kernel, symbols), fixed_too=True)
        return out

    def _timed(self, step: int, name: str, began: float) -> None:
        self.timings.append((step, name, (time.time() - began) * 1000))

    def _wrap(self, rows: DataFrame) -> DataFrame:
        p = self.schema.position
        flat = rows.withColumns({f"_{a}": F.col(f"{p}.{a}") for a in "xyz"})
        flat = images.exchange(flat, self.domain, ("_x", "_y", "_z"))
        out = flat.withColumn(p, F.struct(*(F.col(f"_{a}").alias(a) for a in "xyz"))).drop("_x", "_y", "_z")
        if self.partitioner:
            n, axes = self.partitioner
            flat = images.by_block(out.withColumns({f"_{a}": F.col(f"{p}.{a}") for a in "xyz"}), self.domain, n, axes, ("_x", "_y", "_z"))
            out = flat.drop("_x", "_y", "_z", "bx", "by", "bz")
        return out

    def _with_images(self, rows: DataFrame, halo: float) -> DataFrame:
        if not any(self.domain.periodic):
            return rows.withColumn("is_ghost", F.lit(False))
        p = self.schema.position
        flat = images.images(rows.withColumns({f"_{a}": F.col(f"{p}.{a}") for a in "xyz"}), self.domain, halo, ("_x", "_y", "_z"))
        return flat.withColumn(p, F.struct(*(F.col(f"_{a}").alias(a) for a in "xyz"))).drop("_x", "_y", "_z", "shift_x", "shift_y", "shift_z")

    def step(self, rows: DataFrame, state: DataFrame | None, step: int) -> tuple[DataFrame, DataFrame | None]:
        """One step: pre-step kernels, exchange, images, volatile properties to zero, kernels; contacts that weren't touched go."""
        mark = time.time()

        def timed(name: str, rows: DataFrame) -> DataFrame:
            """With the profiler, each part ends in a table, so that its time is its own."""
            nonlocal mark
            if self.profile:
                self.used.append(rows := cut(rows))
                self._timed(step, name, mark)
                mark = time.time()
            return rows

        for s in self.before:
            if step or not s.skip_first:
                rows = timed(f"kernel:{s.name}", run_row(rows, s.kernel, self._symbols(s.kernel, s.symbols)))
        if due(step, self.period):
            rows = timed("communication:exchange", self._wrap(rows))
        rows = rows.withColumns({p.name: struct_of(p.kind, 0) for p in self.schema.properties.values() if p.volatile})
        after = None
        for s in self.stages:
            if not step and s.skip_first:
                continue
            symbols = self._symbols(s.kernel, s.symbols)
            if s.pair:
                halo = max(self.halo or 0.0, s.cutoff or 0.0)
                radius = None
                if SPHERE in self.shapes:
                    self.used.append(rows := cut(rows))  # the largest radius is asked of a table, not of all that led to it
                    radius = rows.where(F.col("shape") == SPHERE).agg(F.max("radius")).first()[0]
                reach = max(s.cutoff or 0.0, 2 * (radius or 0.0))
                halo = max(halo, 2 * (radius or 0.0))
                if self.listed and self.period > 1 and 0 < reach <= self.halo:
                    self.used.append(rows := cut(rows))  # it is read for the candidates and for the couples
                    stored = self._stored(rows, reach, step)
                    if self.profile:
                        self._timed(step, "neighbors:lists", mark)
                        mark = time.time()
                    rows, touched = run_pair(rows, rows, s.kernel, self.schema, self.shapes, s.cutoff, symbols, state, self.half, radius, stored, self.domain.lengths)
                else:
                    rows, touched = run_pair(rows, self._with_images(rows, halo), s.kernel, self.schema, self.shapes, s.cutoff, symbols, state, self.half, radius)
                after = touched if after is None else after.unionByName(touched).dropDuplicates(contacts.KEY) if touched is not None else after
            else:
                rows = run_row(rows, s.kernel, symbols)
            rows = timed(f"kernel:{s.name}", rows)
        return rows, after

    def kept(self, rows: DataFrame, after: DataFrame | None, *old: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """The tables of a step's particles and contacts; those that led to them are deleted."""
        rows = cut(rows)
        state = cut(after if after is not None else contacts.empty(self.spark, self.schema)) if self.history else None
        forget(*old, *self.used)
        self.used = []
        return rows, state

    def run(self) -> DataFrame:
        """Steps 0 to timesteps, both included; the particles after them. Only the last step's tables are left."""
        rows = cut(self.initial())
        state = contacts.empty(self.spark, self.schema) if self.history else None
        for step in range(self.timesteps + 1):
            began = time.time()
            rows, state = self.kept(*self.step(rows, state, step), rows, state)
            if self.profile:
                self._timed(step, "all", began)
            if self.thermo_every and due(step, self.thermo_every):
                flat = rows.select("mass", "flags", *(F.col(f"linear_velocity.{a}").alias(f"v{a}") for a in "xyz"))
                r = aggregates.thermo(flat, self.domain.volume).first()
                self.thermo_rows.append((step, r.temperature, r.pressure))
            if self.vtk and sinks.vtk_due(step, self.vtk[1]):
                ghosts = self._with_images(rows, self.halo or 0.0).where("is_ghost")
                sinks.write_vtk_step(rows, ghosts, self.vtk[0], step, self.schema.position)
        self.particles, self.state = rows, state
        return rows

    generate = run

    def explain(self, step: int = 1) -> str:
        """The physical plan of one step."""
        state = contacts.empty(self.spark, self.schema) if self.history else None
        return self.step(self.initial(), state, step)[0]._jdf.queryExecution().toString()

    def thermo(self) -> DataFrame:
        return self.spark.createDataFrame(self.thermo_rows, "step int, temperature double, pressure double")

    def timers(self) -> DataFrame:
        """(step, name, ms) of each part of each step, with the profiler; :func:`corpuscle.operators.aggregates.timer_sums` adds them up by category."""
        return self.spark.createDataFrame(self.timings, "step int, name string, ms double")


__all__ = ["Array", "Simulation", "Stage", "cut", "due", "forget", "shared_folder"]
