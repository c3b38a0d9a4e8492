"""Golden figures, equivalences and whole simulations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.model import INT, REAL, VECTOR, Domain, ParticleSchema
from corpuscle.operators import aggregates, contacts, grid, images, interactions
from corpuscle.operators.kernels import Row, run_pair, run_row
from corpuscle.plans import catalog, physics
from corpuscle.plans.simulation import Simulation, due
from corpuscle.sources import particles, sinks
from corpuscle.streaming.steps import SteppedSimulation

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lattice(spark):
    rows, box = particles.fcc_lattice(spark, (4, 4, 4), 0.8442)
    return aggregates.thermostat(rows, 1.44).persist(), box


def test_lattice_golden(lattice):
    rows, box = lattice
    assert rows.count() == 256 and box.high[0] == pytest.approx(6.718384765530029)
    first = rows.where("uid = 0").first()
    assert (first.vx, first.vy, first.vz) == pytest.approx((-1.132164734516598, 0.04896887729394578, -2.0394325085819895))
    t = aggregates.thermo(rows, box.volume).first()
    assert t.temperature == pytest.approx(1.44) and t.pressure == pytest.approx(1.2108992, rel=1e-4)


@pytest.mark.parametrize(("cutoff", "each"), [(2.5, 54), (2.8, 78)])
def test_periodic_neighbours(lattice, cutoff, each):
    rows, box = lattice
    couples = interactions.cutoff_couples(rows, cutoff, images.images(rows, box, 2.8))
    assert {r.n for r in interactions.neighbour_counts(couples).collect()} == {each}
    assert images.images(rows, box, 2.8).count() == 1687


def test_bins_equal_theta(spark):
    rows = catalog.pts(spark, SF)
    theta = rows.alias("i").crossJoin(rows.alias("j")).where("i.uid <> j.uid and (i.flags & 4) = 0 and pow(i.x-j.x,2)+pow(i.y-j.y,2)+pow(i.z-j.z,2) < 0.01")
    binned = interactions.cutoff_couples(rows, 0.1)
    plan = binned._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert binned.count() == theta.count()
    assert interactions.cutoff_couples(rows, 0.1, salt=3).count() == binned.count()


@pytest.mark.parametrize("step", [0.25, 0.1])
def test_range_join_at_the_faces_of_cells(spark, step):
    """Points on a lattice whose distances are the range itself, negative and far from the origin, against a theta join."""
    places = [(x * step + f, y * step, z * step - f) for x in range(-4, 5) for y in range(-2, 3) for z in range(-2, 2) for f in (0.0, 1000.0)]
    rng = np.random.default_rng(1)
    places += [tuple(p) for p in rng.uniform(-1, 1, (150, 3)).tolist()]
    rows = spark.createDataFrame([(k, *p, 0) for k, p in enumerate(places)] + [(9999, None, 0.0, 0.0, 0)], "uid long, x double, y double, z double, flags int")
    p = np.array(places)
    for size in (step, 1.5 * step, math.nextafter(2 * step, 9)):
        d = p[:, None] - p
        want = (d * d).sum(axis=2) < size * size
        np.fill_diagonal(want, False)
        got = interactions.cutoff_couples(rows, size).select("uid_i", "uid_j").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, np.argwhere(want).tolist()))


def test_left_rows_travel_to_few_cells(spark):
    rows = spark.range(20_000).select(*(F.rand(k).alias(a) for k, a in enumerate("xyz")))
    n = rows.select(F.explode(grid.reached(("x", "y", "z"), 0.01, 0.01 * grid.WIDTH)).alias("c")).where("c is not null").count()
    assert 6.7 < n / 20_000 < 7.1
    with pytest.raises(ValueError):
        grid.reached(("x", "y", "z"), 1.0, 2.0)


def test_momentum_is_kept_and_half_equals_full(spark):
    s, rows = catalog._melt(spark, SF)
    rows = rows.withColumn("flags", F.lit(0))
    full = run_pair(rows, rows, physics.lennard_jones, s, [2], 0.1)[0]
    half = run_pair(rows, rows, physics.lennard_jones, s, [2], 0.1, half=True)[0]
    a, b = (np.array([(r.force.x, r.force.y, r.force.z) for r in x.orderBy("uid").select("force").collect()]) for x in (full, half))
    assert np.allclose(a, b, rtol=1e-6, atol=1e-6) and np.allclose(a.sum(axis=0), 0, atol=1e-6)


def test_melt_keeps_energy_bounded_and_stream_equals_batch(spark, lattice, tmp_path):
    rows, box = lattice

    def sim(steps):
        out = Simulation(spark, [2], timesteps=steps)
        out.add_position("position")
        out.add_property("mass", REAL, 1.0)
        out.add_property("linear_velocity", VECTOR)
        out.add_property("force", VECTOR, volatile=True)
        out.add_feature("type", 1)
        out.add_feature_property("type", "epsilon", [1.0])
        out.add_feature_property("type", "sigma6", [1.0])
        out.set_domain([*box.low, *box.high])
        out.add_rows(rows, {"position": ("x", "y", "z"), "linear_velocity": ("vx", "vy", "vz")})
        out.build_neighbor_lists(2.8)
        out.reneighbor_every(2)
        out.compute_thermo(1)
        out.enable_profiler()
        out.vtk_output(str(tmp_path / "melt"), 2)
        out.compute(physics.first_half, symbols={"dt": 0.005}, pre_step=True, skip_first=True)
        out.compute(physics.lennard_jones, 2.5)
        out.compute(physics.second_half, symbols={"dt": 0.005}, skip_first=True)
        return out

    batch = sim(2)
    got = batch.run()
    assert got.count() == 256 and len(batch.thermo_rows) == 3 and batch.timers().where("name = 'all'").count() == 3
    assert all(0.5 < t < 2.0 for _, t, _ in batch.thermo_rows)
    text = (tmp_path / "melt_local_0_2.vtk").read_text()
    assert "POINTS 256 double" in text and not (tmp_path / "melt_local_0_1.vtk").exists() and "POINTS" in (tmp_path / "melt_ghost_0_2.vtk").read_text()

    steps = tmp_path / "steps"
    for k in range(3):
        spark.createDataFrame([(k,)], "step int").coalesce(1).write.mode("append").json(str(steps))
    stepped = SteppedSimulation(sim(2), str(tmp_path / "kept"))
    q = stepped.start(spark.readStream.schema("step int").json(str(steps)), str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    assert stepped.done == 2
    again = SteppedSimulation(sim(2), str(tmp_path / "kept"))  # after a restart
    assert again.done == 2
    again.batch(spark.createDataFrame([(1,), (2,)], "step int"), 0)
    assert again.done == 2 and again.rows.count() == 256
    a, b = ({r.uid: r.position for r in x.collect()} for x in (got, again.rows))
    assert all(abs(a[u].x - b[u].x) < 1e-9 for u in a)


def test_granular_spheres_settle_with_history(spark):
    sim = Simulation(spark, [0, 1], timesteps=2, use_contact_history=True)
    sim.add_position("position")
    for name, kind, default, volatile in (("mass", REAL, 1.0, False), ("radius", REAL, 1.0, False), ("linear_velocity", VECTOR, 0.0, False), ("angular_velocity", VECTOR, 0.0, False), ("force", VECTOR, 0.0, True), ("torque", VECTOR, 0.0, True), ("normal", VECTOR, 0.0, False)):
        sim.add_property(name, kind, default, volatile)
    from corpuscle.model import MATRIX, QUATERNION

    sim.add_property("inv_inertia", MATRIX)
    sim.add_property("rotation_matrix", MATRIX)
    sim.add_property("rotation_quat", QUATERNION, [1.0, 0.0, 0.0, 0.0])
    sim.add_feature("type", 1)
    sim.add_feature_property("type", "friction_static", [0.0])
    sim.add_feature_property("type", "friction_dynamic", [0.5])
    sim.add_contact_property("is_sticking", INT, 0)
    sim.add_contact_property("tangential_spring_displacement", VECTOR)
    sim.add_contact_property("impact_velocity_magnitude", REAL)
    sim.pbc([False] * 3)
    sim.set_domain([0, 0, 0, 1, 1, 1])
    balls = spark.createDataFrame([(1, 0.5, 0.5, 0.099, 0.1, 1.0, 0, 0, -1.0), (2, 0.5, 0.5, 0.29, 0.1, 1.0, 0, 0, -1.0), (3, 0.1, 0.1, 0.8, 0.1, 1.0, 0, 0, 0.0)], "uid long, x double, y double, z double, radius double, mass double, flags int, shape int, vz double").withColumns({"vx": F.lit(0.0), "vy": F.lit(0.0)})
    sim.add_rows(balls, {"position": ("x", "y", "z"), "linear_velocity": ("vx", "vy", "vz")})
    plane = spark.createDataFrame([(100, 0.0, 0.0, 0.0, 1.0, 13, 1, 0.0, 0.0, 1.0)], "uid long, x double, y double, z double, mass double, flags int, shape int, nx double, ny double, nz double")
    sim.add_rows(plane, {"position": ("x", "y", "z"), "normal": ("nx", "ny", "nz")})
    sim.setup(physics.mass_and_inertia)
    sim.compute(physics.spring_dashpot, symbols={"dt": 1e-4, "restitution": 0.5, "collision_time": 0.01, "poisson": 0.2}, pair=True)
    sim.compute(physics.gravity, symbols={"particle_density": 2550.0, "fluid_density": 0.0, "g": 9.81})
    sim.compute(physics.euler, symbols={"dt": 1e-4})
    out = {r.uid: r for r in sim.run().collect()}
    state = {(r.uid_i, r.uid_j): r for r in sim.state.collect()}
    assert set(state) == {(1, 100), (1, 2), (2, 1)}
    assert out[100].position.z == 0 and math.isinf(out[100].mass)
    assert out[2].linear_velocity.z > -1.0 and out[1].linear_velocity.z < -1.0 and out[3].linear_velocity.z < 0
    assert state[1, 100].impact_velocity_magnitude == pytest.approx(1.0)


def test_touch_rule(spark):
    s = ParticleSchema()
    s.add_position()
    s.add("radius", REAL)
    s.add_contact("seen", INT, 0)
    flat = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 1.0), (3, 1.9, 1.0)], "uid long, x double, radius double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    rows = particles.nested(flat, s, {"position": ("x", "y", "z")})

    def kernel(p):
        p.skip_when(p.penetration_depth > -0.5)
        p.set_contact("seen", p.contact("seen") + 1)

    state = run_pair(rows, rows, kernel, s, [0], None, state=contacts.empty(spark, s))[1]
    assert {(r.uid_i, r.uid_j) for r in state.collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}
    again = run_pair(rows, rows, kernel, s, [0], None, state=state)[1]
    assert {r.seen for r in again.collect()} == {2}
    with pytest.raises(ValueError):
        run_pair(rows, rows, kernel, s, [1], None)


def test_wrong_uses(spark):
    s = ParticleSchema()
    s.add_position()
    with pytest.raises(ValueError):
        s.add("position", REAL)
    with pytest.raises(ValueError):
        s.add_position("other")
    with pytest.raises(ValueError):
        Domain.of([0, 0, 0, 0, 1, 1])
    rows = spark.createDataFrame([(1, 0)], "uid long, flags int")
    with pytest.raises(TypeError):
        run_row(rows.withColumn("v", F.struct(*(F.lit(1.0).alias(a) for a in "xyz"))), lambda i: i.__setitem__("flags", i["v"]))
    sim = Simulation(spark, [2])
    with pytest.raises(ValueError):
        sim.run()
    sim.compute(physics.euler)
    with pytest.raises(ValueError):
        sim.compute(physics.euler)


def test_row_kernel_order_and_fixed(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 2.0), (2, 4, 1.0, 2.0)], "uid long, flags int, v double, x double")

    def kernel(i: Row) -> None:
        i["v"] = i["v"] + 1
        i["x"] = i["x"] + i["v"]

    assert {(r.uid, r.v, r.x) for r in run_row(rows, kernel).collect()} == {(1, 2.0, 4.0), (2, 1.0, 2.0)}
    assert {r.x for r in run_row(rows, kernel, fixed_too=True).collect()} == {4.0}


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("7,0.5,0.5,0.5,2.5,0\n8,5,5,5,1.5,4\n9,5,5,5,1.5,0\n")
    s = ParticleSchema()
    s.add_position()
    s.add("mass", REAL, 1.0)
    s.add("radius", REAL, 3.0)
    box = Domain.of([0, 0, 0, 1, 1, 1])
    got = {r.uid: r for r in particles.read_csv(spark, str(tmp_path / "a.csv"), ["uid", "position", "mass", "flags"], s, 0, box).collect()}
    assert set(got) == {7, 8} and got[7].radius == 3.0 and got[7].position.y == 0.5 and got[8].flags == 4
    with pytest.raises(Exception, match="(?i)not.exist"):
        particles.read_csv(spark, str(tmp_path / "none.csv"), ["uid"], s, 0)
    (tmp_path / "d.csv").write_text("0,0,0,1,2,3\n")
    assert particles.read_domain(spark, str(tmp_path / "d.csv")).volume == 6.0
    (tmp_path / "l.csv").write_text("0,0,1.5\n0,1,2.5\n")
    assert particles.read_lookup(spark, str(tmp_path / "l.csv")).count() == 2
    sinks.write_steps(spark.range(3).toDF("uid"), str(tmp_path / "out"), 0)
    sinks.write_steps(spark.range(4).toDF("uid"), str(tmp_path / "out"), 1)
    sinks.write_steps(spark.range(5).toDF("uid"), str(tmp_path / "out"), 1)
    assert {r.step: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("step").count().collect()} == {0: 3, 1: 5}


def test_blocks_and_schedule():
    box = Domain.of([0, 0, 0, 4, 2, 1])
    assert images.block_grid(8, box) == (4, 2, 1) and images.block_grid(4, box, (True, True, False))[2] == 1
    with pytest.raises(ValueError):
        images.block_grid(2, box, (False, False, False))
    assert [k for k in range(8) if due(k, 3)] == [0, 2, 5] and sinks.vtk_due(4, 0) and not sinks.vtk_due(3, 2)
    assert grid.stencil_cells(box, 1.0)[0] == [7, 5, 4]


def test_stored_lists_equal_fresh_joins(spark, lattice):
    rows, box = lattice

    def positions(listed):
        sim = Simulation(spark, [2], timesteps=2)
        sim.add_position("position")
        sim.add_property("mass", REAL, 1.0)
        sim.add_property("linear_velocity", VECTOR)
        sim.add_property("force", VECTOR, volatile=True)
        sim.add_feature("type", 1)
        sim.add_feature_property("type", "epsilon", [1.0])
        sim.add_feature_property("type", "sigma6", [1.0])
        sim.set_domain([*box.low, *box.high])
        sim.add_rows(rows, {"position": ("x", "y", "z"), "linear_velocity": ("vx", "vy", "vz")})
        if listed == "cells":
            sim.build_cell_lists(2.8, store_neighbors_per_cell=True)
        else:
            (sim.build_neighbor_lists if listed else sim.build_cell_lists)(2.8)
        sim.reneighbor_every(20)
        sim.compute(physics.first_half, symbols={"dt": 0.01}, pre_step=True, skip_first=True)
        sim.compute(physics.lennard_jones, 2.5)
        return {r.uid: tuple(r.position) for r in sim.run().collect()}

    b = positions(False)
    for listed in (True, "cells"):
        a = positions(listed)
        assert set(a) == set(b) and all(a[u] == pytest.approx(b[u], abs=1e-9) for u in a)


def test_variables_and_arrays_in_kernels(spark, lattice):
    rows, box = lattice
    sim = Simulation(spark, [2], timesteps=0)
    sim.add_position("position")
    sim.add_property("mass", REAL, 1.0)
    sim.set_domain([*box.low, *box.high])
    sim.add_rows(rows.select("uid", "x", "y", "z", "shape", "flags"), {"position": ("x", "y", "z")})
    sim.add_var("factor", 3.0)
    sim.add_static_array("table", [1.0, 5.0])

    def scaled(p, factor, table):
        p["mass"] = p["mass"] * factor + table[1]

    sim.compute(scaled)
    assert {r.mass for r in sim.run().select("mass").collect()} == {8.0}


def test_range_join_of_rows_that_flew_far(spark):
    """Close rows push each other out of any cell's number: cells beyond it are one, and what lies together there meets."""
    places = [(1e20, 0.0, 0.0), (1e20, 0.05, 0.0), (-1e20, 0.0, 1e300), (-1e20, 0.0, 1e300), (0.0, 0.0, 0.0), (0.05, 0.0, 0.0), (math.inf, 0.0, 0.0), (math.nan, 0.0, 0.0)]
    rows = spark.createDataFrame([(k, *p, 0) for k, p in enumerate(places)], "uid long, x double, y double, z double, flags int")
    i, j = (interactions.side(rows, t, ["uid", *"xyz"]) for t in "ij")
    near = (interactions._delta().squared_length() < 0.01) & (F.col("uid_i") != F.col("uid_j"))
    for width in (grid.WIDTH, 1.0, 0.5):
        got = grid.range_join(i, j, ("x_i", "y_i", "z_i"), ("x_j", "y_j", "z_j"), 0.1, near, width=width)
        assert sorted((r.uid_i, r.uid_j) for r in got.collect()) == [(0, 1), (1, 0), (2, 3), (3, 2), (4, 5), (5, 4)]


def test_crowded_rows_meet_in_narrow_cells(spark):
    """A crowd is sorted into narrow cells, never broadcast, and few spare couples are tested."""
    rows = spark.range(3000).select(F.col("id").alias("uid"), *((F.rand(k) * 0.4).alias(a) for k, a in enumerate("xyz")), F.lit(0).alias("flags")).persist()
    assert grid.fitting_width(rows, ("x", "y", "z"), 0.1) < 2 < grid.fitting_width(rows.limit(50), ("x", "y", "z"), 0.1)
    couples = interactions.cutoff_couples(rows, 0.1)
    plan = couples._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    p = np.array([(r.x, r.y, r.z) for r in rows.orderBy("uid").collect()])
    d = p[:, None] - p
    want = (d * d).sum(axis=2) < 0.1 * 0.1
    assert couples.count() == want.sum() - len(p)
    i = interactions.side(rows, "i", ["uid", *"xyz"])
    for size, width in ((0.1, 1.0), (0.1, 0.5)):
        n = grid.sent(i, ("x_i", "y_i", "z_i"), size, width * size).count() / 3000
        assert n == pytest.approx(1 + 6 / width + 3 * math.pi / width**2 + 4 / 3 * math.pi / width**3, rel=0.03)


def test_couples_are_not_sent_to_meet_no_state(spark):
    """Without a state and without images, what a step knows of its couples is added up where they met; only sums by row travel."""
    s = ParticleSchema()
    s.add_position()
    s.add("radius", REAL)
    s.add_contact("seen", INT, 0)
    flat = spark.createDataFrame([(k, 0.3 * k, 1.0) for k in range(40)], "uid long, x double, radius double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    rows = particles.nested(flat, s, {"position": ("x", "y", "z")})

    def kernel(p):
        p.set_contact("seen", p.contact("seen") + 1)

    state = run_pair(rows, rows, kernel, s, [0], None, state=contacts.empty(spark, s), max_radius=1.0)[1]
    got = state.groupBy("uid_i").agg(F.sum("seen").alias("n"))
    assert "hashpartitioning(uid_i#" in (plan := got._jdf.queryExecution().executedPlan().toString())
    assert not [x for x in plan.splitlines() if "hashpartitioning(uid_i#" in x and "uid_j#" in x]
    want = {u: sum(0.3 * abs(u - v) < 2.0 for v in range(40) if v != u) for u in range(40)}
    assert {r.uid_i: r.n for r in got.collect()} == want


def test_replayed_steps_equal_stored_state(spark):
    """The history of contacts from one join equals the state stored from step to step, and no couple travels for it."""
    rows = catalog.pts(spark, SF)
    state = spark.createDataFrame([], "uid_i long, uid_j long, seen int, first_depth double")
    for k in range(3):
        now = rows.withColumns({a: F.col(a) + F.col(f"v{a}") * 0.05 * k for a in "xyz"})
        met = contacts.touch(interactions.sphere_contacts(now, 0.048).select("uid_i", "uid_j", "depth"), state, {"seen": 0, "first_depth": 0.0})
        met = met.withColumn("first_depth", F.when(F.col("seen") == 0, F.col("depth")).otherwise(F.col("first_depth"))).withColumn("seen", F.col("seen") + 1)
        first, state = state, contacts.pruned(met, ["seen", "first_depth"]).persist()
        if k == 1:
            reset = contacts.reset(met, first, {"seen": 0, "first_depth": 0.0}).collect()
    by_couple = lambda x: {(r.uid_i, r.uid_j, r.seen): r.first_depth for r in x}
    got, again = catalog.contact_prune(spark, SF), catalog.contact_reset(spark, SF)
    for new, old, seen in ((got.collect(), state.collect(), {1, 2, 3}), (again.collect(), reset, {0, 1, 2})):
        assert {r.seen for r in new} == seen and len(new) == len(old) and by_couple(new) == pytest.approx(by_couple(old), abs=1e-6)
    for q in (got, again, catalog.contact_insert(spark, SF), catalog.contact_persist(spark, SF)):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_cx#" in plan and "hashpartitioning(uid_i#" not in plan


@pytest.mark.parametrize("name", ["neighbor_lists", "verlet_couples", "sphere_list", "cell_list_couples", "feature_lookup"])
def test_couples_do_not_travel_by_uid(spark, name):
    """With rows too many to be broadcast, too, candidates and lists are used where they were found."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "hashpartitioning(" in plan and "hashpartitioning(uid" not in plan and "hashpartitioning(type" not in plan


def test_candidates_carry_places_of_images(spark, lattice):
    rows, box = lattice
    now = ("now_x", "now_y", "now_z")
    rows = rows.withColumns({n: F.col(a) + 0.05 * F.col(f"v{a}") for a, n in zip("xyz", now, strict=True)})
    near = images.images(rows, box, 2.8)
    moved = rows.withColumns({a: F.col(n) for a, n in zip("xyz", now, strict=True)})
    want = interactions.from_candidates(moved, interactions.candidates(rows, near, 2.8), 2.5, box.lengths)
    rounded = lambda x: sorted((r.uid_i, r.uid_j, round(r.rsq, 9)) for r in x.select("uid_i", "uid_j", "rsq").collect())
    for build in (interactions.candidates, interactions.cell_couples):
        got = interactions.from_carried(build(rows, near, 2.8, carried=now), 2.5, box.lengths, now)
        assert rounded(got) == rounded(want)
