"""The kernels of the two example programs: a Lennard-Jones melt, and settling granular spheres."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corpuscle.functions.algebra import Mat, Quat, Vec, safe_div, select, smallest
from corpuscle.model import SPHERE
from corpuscle.operators.kernels import Pair, Row


def lennard_jones(p: Pair) -> None:
    """Needs lookups epsilon and sigma6."""
    inverse = p.let("inverse", safe_div(1.0, p.squared_distance))
    sixth = p.let("sixth", inverse * inverse * inverse * p.lookup("sigma6"))
    p.apply("force", p.delta * (48.0 * sixth * (sixth - 0.5) * inverse * p.lookup("epsilon")))


def first_half(i: Row, dt: float) -> None:
    i["linear_velocity"] = i["linear_velocity"] + i["force"] * (0.5 * dt) / i["mass"]
    i["position"] = i["position"] + i["linear_velocity"] * dt


def second_half(i: Row, dt: float) -> None:
    i["linear_velocity"] = i["linear_velocity"] + i["force"] * (0.5 * dt) / i["mass"]


def mass_and_inertia(i: Row) -> None:
    """Spheres get their inverse inertia; other shapes can't be moved."""
    ball = i.is_shape(SPHERE)
    moment = 0.4 * i["mass"] * i["radius"] * i["radius"]
    i["inv_inertia"] = select(ball, Mat.diagonal(safe_div(1.0, moment)), Mat.fill(0.0))
    i["mass"] = select(ball, i["mass"], float("inf"))
    i["rotation_matrix"] = Mat.diagonal(1.0)
    i["rotation_quat"] = Quat.identity()


def spring_dashpot(p: Pair, dt: float, restitution: float, collision_time: float, poisson: float, static: str = "friction_static", dynamic: str = "friction_dynamic") -> None:
    """Normal spring and damping; tangential spring with history; sticking and sliding friction."""
    log_e, kappa = math.log(restitution), 2 * (1 - poisson) / (2 - poisson)
    push = p.let("push", -p.penetration_depth)
    p.skip_when(push < 0)
    n, at = p.contact_normal, p.contact_point
    m = p.let("m", 1.0 / (safe_div(1.0, p.i["mass"]) + safe_div(1.0, p.j["mass"])))
    k_n = p.let("k_n", m * ((math.pi**2 + log_e**2) / collision_time**2))
    g_n = p.let("g_n", m * (-2.0 * log_e / collision_time))
    k_t, g_t = k_n * kappa, g_n * math.sqrt(kappa)

    def speed(side) -> Vec:
        return side["linear_velocity"] + side["angular_velocity"].cross(at - side["position"])

    v = p.let("v", -(speed(p.i) - speed(p.j)))
    v_n = p.let("v_n", n * v.dot(n))
    v_t = p.let("v_t", v - v_n)
    f_n = p.let("f_n", n * (k_n * push) + v_n * g_n)
    old = p.contact("tangential_spring_displacement")
    flat = p.let("flat", old - n * old.dot(n))
    turned = flat * F.when(flat.squared_length() <= 0, 0.0).otherwise(F.sqrt(safe_div(old.squared_length(), flat.squared_length())))
    spring = p.let("spring", v_t * dt + turned)
    f_t = p.let("f_t", spring * k_t + v_t * g_t)
    size = p.let("size", f_t.length())
    along = p.let("along", f_t.normalized())
    hold, slide = p.let("hold", p.lookup(static) * f_n.length()), p.let("slide", p.lookup(dynamic) * f_n.length())
    sticking = p.contact("is_sticking") == 1
    c1 = p.let("c1", sticking & (v_t.length() < 1e-8) & (size < hold))
    c2 = p.let("c2", sticking & (size < slide))
    most = p.let("most", F.when(c1, hold).otherwise(slide))
    p.set_contact("is_sticking", F.when(c1 | c2 | (size < slide), 1).otherwise(0))
    slid = Vec(*(safe_div(most * a - g_t * b, k_t) for a, b in zip(along.parts, v_t.parts, strict=True)))
    p.set_contact("tangential_spring_displacement", select(~c1 & ~c2 & (k_t > 0), slid, spring))
    impact = p.contact("impact_velocity_magnitude")
    p.set_contact("impact_velocity_magnitude", F.when(impact > 0, impact).otherwise(v.length()))
    force = p.let("force", f_n + along * smallest(size, most))
    p.apply("force", force)
    p.apply("torque", lambda side: (at - side["position"]).cross(force))


def euler(i: Row, dt: float) -> None:
    """Positions move with the old velocities."""
    push = i.let("push", i["force"] / i["mass"])
    i["position"] = i["position"] + push * (0.5 * dt * dt) + i["linear_velocity"] * dt
    i["linear_velocity"] = i["linear_velocity"] + push * dt
    turn = i.let("turn", (i["rotation_matrix"] * (i["inv_inertia"] * i["torque"])) * i["rotation_matrix"].transposed())
    angle = i.let("angle", i["angular_velocity"] * dt + turn * (0.5 * dt * dt))
    i["rotation_quat"] = i.let("spun", Quat.rotation(angle, angle.length())) * i["rotation_quat"]
    i["rotation_matrix"] = i["rotation_quat"].matrix()
    i["angular_velocity"] = i["angular_velocity"] + turn * dt


def gravity(i: Row, particle_density: float, fluid_density: float, g: float) -> None:
    volume = 4.0 / 3.0 * math.pi * i["radius"] * i["radius"] * i["radius"]
    i["force"] = i["force"].with_part(2, i["force"].z - (particle_density - fluid_density) * volume * g)
