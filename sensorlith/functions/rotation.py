"""Quaternion and tilt columns. A quaternion is a tuple of four columns (w, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorlith.functions.numbers import magnitude
from sensorlith.functions.units import STANDARD_GRAVITY

Quat = tuple[Column, Column, Column, Column]


def normalise(q: Quat) -> Quat:
    n = magnitude(*q)
    return tuple(F.when(n > 0, c / n).otherwise(c) for c in q)


def multiply(p: Quat, q: Quat) -> Quat:
    pw, px, py, pz = p
    qw, qx, qy, qz = q
    return (
        pw * qw - (px * qx + py * qy + pz * qz),
        pw * qx + qw * px + (py * qz - pz * qy),
        pw * qy + qw * py + (pz * qx - px * qz),
        pw * qz + qw * pz + (px * qy - py * qx),
    )


def from_axis_angle(x: Column, y: Column, z: Column, angle: Column) -> Quat:
    """Null where the axis has no length."""
    n = magnitude(x, y, z)
    s = F.when(n > 0, F.sin(angle / 2.0) / n)
    return normalise((F.when(n > 0, F.cos(angle / 2.0)), x * s, y * s, z * s))


def from_rate(wx: Column, wy: Column, wz: Column, dt: Column) -> Quat:
    """Rotation by rate (wx, wy, wz) over dt; no rotation gives the unit quaternion."""
    angle = magnitude(wx * dt, wy * dt, wz * dt)
    s = F.when(angle > 0, F.sin(angle / 2.0) / angle).otherwise(0.0)
    return (F.cos(angle / 2.0), wx * dt * s, wy * dt * s, wz * dt * s)


def to_euler(q: Quat) -> tuple[Column, Column, Column]:
    w, x, y, z = q
    side = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2.0 * (w * y - z * x)))
    roll = F.atan2(2.0 * (w * x + y * z), 1.0 - 2.0 * (x * x + y * y))
    yaw = F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))
    return roll, F.asin(side), yaw


def from_euler(roll: Column, pitch: Column, yaw: Column) -> Quat:
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(a / 2.0), F.sin(a / 2.0)) for a in (roll, pitch, yaw))
    return normalise(
        (
            cr * cp * cy + sr * sp * sy,
            sr * cp * cy - cr * sp * sy,
            cr * sp * cy + sr * cp * sy,
            cr * cp * sy - sr * sp * cy,
        )
    )


def rotate(q: Quat, v: tuple[Column, Column, Column], inverse: bool = False) -> tuple[Column, Column, Column]:
    """R(q)·v, or its transpose times v: v + 2w(u×v) + 2u×(u×v) for the unit quaternion (w, u)."""
    w, x, y, z = normalise(q)
    if inverse:
        x, y, z = -x, -y, -z
    vx, vy, vz = v
    cx, cy, cz = y * vz - z * vy, z * vx - x * vz, x * vy - y * vx
    return (
        vx + 2.0 * (w * cx + (y * cz - z * cy)),
        vy + 2.0 * (w * cy + (z * cx - x * cz)),
        vz + 2.0 * (w * cz + (x * cy - y * cx)),
    )


def rotation_matrix(q: Quat) -> Column:
    """3×3 array of arrays; the quaternion is brought to length one."""

    def rows(u: Column) -> Column:
        w, x, y, z = (u[i] for i in range(4))
        return F.array(
            F.array(1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - w * z), 2.0 * (x * z + w * y)),
            F.array(2.0 * (x * y + w * z), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - w * x)),
            F.array(2.0 * (x * z - w * y), 2.0 * (y * z + w * x), 1.0 - 2.0 * (x * x + y * y)),
        )

    return F.transform(F.array(F.array(*normalise(q))), rows)[0]  # the length is taken once


def tilt(gx: Column, gy: Column, gz: Column) -> tuple[Column, Column]:
    """Roll and pitch (rad) from the gravity vector."""
    return F.atan2(gy, gz), F.atan2(-gx, F.sqrt(gy * gy + gz * gz))


def linear_acceleration(world: tuple[Column, Column, Column]) -> tuple[Column, Column, Column, Column]:
    """World-frame acceleration without gravity, and its size."""
    x, y, z = world[0], world[1], world[2] - STANDARD_GRAVITY
    return x, y, z, magnitude(x, y, z)


def yaw_of(q: Quat) -> Column:
    w, x, y, z = q
    return F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))
