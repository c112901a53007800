"""Rotations and rigid motions as column expressions over structs, with numpy twins for ordered folds.

Quaternions are structs (qx, qy, qz, qw); poses add (tx, ty, tz) and map body coordinates to the reference frame;
planar poses are (x, y, theta) with theta above -pi and up to pi.

Arguments appear several times in what these functions build, so pass columns rather than long expressions, and put
a step's result into a column of its own before the next step uses it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SMALL = 1e-10


def quaternion(qx, qy, qz, qw) -> Column:
    """From four columns, scaled to length one; the identity where all are zero."""
    q = [F.lit(x) if not isinstance(x, Column) else x for x in (qx, qy, qz, qw)]
    n = F.sqrt(sum(x * x for x in q))
    return F.struct(*[F.when(n > 0, x / n).otherwise(float(k == 3)).alias(name) for k, (x, name) in enumerate(zip(q, ("qx", "qy", "qz", "qw"), strict=True))])


def q_multiply(a: Column, b: Column) -> Column:
    ax, ay, az, aw = (a[k] for k in ("qx", "qy", "qz", "qw"))
    bx, by, bz, bw = (b[k] for k in ("qx", "qy", "qz", "qw"))
    return F.struct(
        (aw * bx + ax * bw + ay * bz - az * by).alias("qx"),
        (aw * by - ax * bz + ay * bw + az * bx).alias("qy"),
        (aw * bz + ax * by - ay * bx + az * bw).alias("qz"),
        (aw * bw - ax * bx - ay * by - az * bz).alias("qw"),
    )


def q_inverse(q: Column) -> Column:
    return F.struct((-q["qx"]).alias("qx"), (-q["qy"]).alias("qy"), (-q["qz"]).alias("qz"), q["qw"].alias("qw"))


def vector(x, y, z) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for v, k in ((x, "x"), (y, "y"), (z, "z"))])


def rotate(q: Column, v: Column) -> Column:
    """v + 2 w (u x v) + 2 u x (u x v), u the vector part."""
    ux, uy, uz, w = (q[k] for k in ("qx", "qy", "qz", "qw"))
    x, y, z = (v[k] for k in "xyz")
    cx, cy, cz = 2 * (uy * z - uz * y), 2 * (uz * x - ux * z), 2 * (ux * y - uy * x)
    return vector(x + w * cx + uy * cz - uz * cy, y + w * cy + uz * cx - ux * cz, z + w * cz + ux * cy - uy * cx)


def q_exp(x: Column, y: Column, z: Column) -> Column:
    """Rotation of a rotation vector."""
    angle = F.sqrt(x * x + y * y + z * z)
    k = F.when(angle > _SMALL, F.sin(angle / 2) / angle).otherwise(0.5)
    return F.struct((x * k).alias("qx"), (y * k).alias("qy"), (z * k).alias("qz"), F.cos(angle / 2).alias("qw"))


def q_log(q: Column) -> Column:
    """Rotation vector of the shorter way round."""
    s = F.when(q["qw"] < 0, -1.0).otherwise(1.0)
    n = F.sqrt(q["qx"] * q["qx"] + q["qy"] * q["qy"] + q["qz"] * q["qz"])
    k = F.when(n > _SMALL, 2 * F.atan2(n, s * q["qw"]) / n).otherwise(2.0) * s
    return vector(q["qx"] * k, q["qy"] * k, q["qz"] * k)


def from_rpy(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(a / 2), F.sin(a / 2)) for a in (roll, pitch, yaw))
    return F.struct(
        (sr * cp * cy - cr * sp * sy).alias("qx"),
        (cr * sp * cy + sr * cp * sy).alias("qy"),
        (cr * cp * sy - sr * sp * cy).alias("qz"),
        (cr * cp * cy + sr * sp * sy).alias("qw"),
    )


def to_rpy(q: Column) -> Column:
    x, y, z, w = (q[k] for k in ("qx", "qy", "qz", "qw"))
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))
    return F.struct(
        F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)).alias("roll"),
        F.asin(sine).alias("pitch"),
        F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)).alias("yaw"),
    )


def yaw(q: Column) -> Column:
    """The turn about the vertical."""
    return F.atan2(2 * (q["qw"] * q["qz"] + q["qx"] * q["qy"]), 1 - 2 * (q["qy"] * q["qy"] + q["qz"] * q["qz"]))


def symbol_key(letter: str, number: Column) -> Column:
    """The key of a variable in a factor graph: a letter in the top byte, a number below it."""
    return F.lit(ord(letter) << 56).bitwiseOR(number.cast("long"))


def pose(t: Column, q: Column) -> Column:
    return F.struct(t["x"].alias("tx"), t["y"].alias("ty"), t["z"].alias("tz"), *[q[k].alias(k) for k in ("qx", "qy", "qz", "qw")])


def literal_pose(x: float, y: float, z: float, roll: float = 0.0, pitch: float = 0.0, yaw: float = 0.0) -> Column:
    """A pose known when the plan is made: plain numbers in the plan, nothing to compute for each row."""
    q = np.array([0.0, 0.0, 0.0, 1.0])
    for axis, angle in ((2, yaw), (1, pitch), (0, roll)):
        turn = np.zeros(3)
        turn[axis] = angle
        q = np_multiply(q, np_exp(turn))
    return F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("tx", "ty", "tz", "qx", "qy", "qz", "qw"), (x, y, z, *q), strict=True)])


def _t(p: Column) -> Column:
    return vector(p["tx"], p["ty"], p["tz"])


def transform_point(p: Column, v: Column) -> Column:
    r = rotate(p, v)
    return vector(r["x"] + p["tx"], r["y"] + p["ty"], r["z"] + p["tz"])


def compose(a: Column, b: Column) -> Column:
    return pose(transform_point(a, _t(b)), q_multiply(a, b))


def inverse(p: Column) -> Column:
    q = q_inverse(p)
    t = rotate(q, _t(p))
    return pose(vector(-t["x"], -t["y"], -t["z"]), q)


def wrap_angle(theta: Column) -> Column:
    """To above -pi and up to pi."""
    turned = F.pmod(theta, F.lit(2 * math.pi))
    return F.when(turned > math.pi, turned - 2 * math.pi).otherwise(turned)


def se2(x, y, theta) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), wrap_angle(theta).alias("theta"))


def se2_compose(a: Column, b: Column) -> Column:
    c, s = F.cos(a["theta"]), F.sin(a["theta"])
    return se2(a["x"] + c * b["x"] - s * b["y"], a["y"] + s * b["x"] + c * b["y"], a["theta"] + b["theta"])


def se2_inverse(a: Column) -> Column:
    c, s = F.cos(a["theta"]), F.sin(a["theta"])
    return se2(-c * a["x"] - s * a["y"], s * a["x"] - c * a["y"], -a["theta"])


# ---- numpy twins


def np_exp(w: np.ndarray) -> np.ndarray:
    angle = math.sqrt(float(w @ w))
    k = math.sin(angle / 2) / angle if angle > _SMALL else 0.5
    return np.array([w[0] * k, w[1] * k, w[2] * k, math.cos(angle / 2)])


def np_multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = a[3] * b[:3] + b[3] * a[:3] + np.cross(a[:3], b[:3])
    return np.append(v, a[3] * b[3] - a[:3] @ b[:3])


def np_rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    c = 2 * np.cross(q[:3], v)
    return v + q[3] * c + np.cross(q[:3], c)


def np_inverse(q: np.ndarray) -> np.ndarray:
    return np.array([-q[0], -q[1], -q[2], q[3]])


def np_rpy(q: np.ndarray) -> tuple[float, float, float]:
    x, y, z, w = q
    return (
        math.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)),
        math.asin(max(-1.0, min(1.0, 2 * (w * y - z * x)))),
        math.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)),
    )
