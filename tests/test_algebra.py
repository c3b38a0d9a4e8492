import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions.algebra import Mat, Quat, Vec, int_div, largest, remainder, safe_div, smallest


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(50, 16))
    return rows, spark.createDataFrame([tuple(map(float, r)) for r in rows], [f"c{k}" for k in range(16)])


def collected(df, *cols):
    return np.array([tuple(r) for r in df.select(*(c.alias(f"r{k}") for k, c in enumerate(cols))).collect()], float)


def test_matrices(data):
    rows, df = data
    m = Mat(*(F.col(f"c{k}") for k in range(9)))
    v = Vec(*(F.col(f"c{k}") for k in range(9, 12)))
    a, b = rows[:, :9].reshape(-1, 3, 3), rows[:, 9:12]
    assert np.allclose(collected(df, *m.inversed().parts).reshape(-1, 3, 3), np.linalg.inv(a))
    assert np.allclose(collected(df, *(m * v).parts), np.einsum("nij,nj->ni", a, b))
    assert np.allclose(collected(df, *(v * m).parts), np.einsum("nij,nj->ni", a, b))
    assert np.allclose(collected(df, *(m * m).parts).reshape(-1, 3, 3), a @ a)
    assert np.allclose(collected(df, *m.transposed().parts).reshape(-1, 3, 3), a.transpose(0, 2, 1))
    assert np.allclose(collected(df, *(m * m.inversed()).parts), np.eye(3).ravel(), atol=1e-6)


def test_vectors(data):
    rows, df = data
    a, b = Vec(*(F.col(f"c{k}") for k in range(3))), Vec(*(F.col(f"c{k}") for k in range(3, 6)))
    x, y = rows[:, :3], rows[:, 3:6]
    assert np.allclose(collected(df, *a.cross(b).parts), np.cross(x, y))
    assert np.allclose(collected(df, a.dot(a.cross(b))), 0, atol=1e-9)
    assert np.allclose(collected(df, a.normalized().length()), 1)
    assert np.allclose(collected(df, *Vec(0.0, 0.0, 0.0).normalized().parts), 0)


def test_quaternions(data):
    rows, df = data
    q = Quat.rotation(Vec(*(F.col(f"c{k}") for k in range(3))), F.col("c3"))
    r = collected(df, *q.matrix().parts).reshape(-1, 3, 3)
    assert np.allclose(r @ r.transpose(0, 2, 1), np.eye(3), atol=1e-9)
    assert np.allclose(np.linalg.det(r), 1)
    assert np.allclose(collected(df, (q * q).length()), 1)
    p = Quat.rotation(Vec(*(F.col(f"c{k}") for k in range(4, 7))), F.col("c7"))
    s = collected(df, *p.matrix().parts).reshape(-1, 3, 3)
    assert np.allclose(collected(df, *(q * p).matrix().parts).reshape(-1, 3, 3), r @ s, atol=1e-9)
    assert np.allclose(collected(df, *Quat.rotation(Vec(0.0, 0.0, 0.0), 1.0).parts), [1, 0, 0, 0])


def test_scalars(spark):
    df = spark.range(1)
    got = df.select(int_div(-7, 2), int_div(7, -2), remainder(-7, 3), safe_div(1.0, 0.0, 5.0), smallest(F.lit(3), 1, 2), largest(1.0, float("nan"), 2.0)).first()
    assert tuple(got) == (-3, -3, -1, 5.0, 1, 2.0)


def test_wrong_types():
    with pytest.raises(ValueError):
        Vec(1.0, 2.0)
    with pytest.raises(TypeError):
        Quat.identity() * 2.0
