"""Column expressions on pixel rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def inverse_mixing(a11: float, a12: float, a21: float, a22: float, eps: float = 1e-15) -> tuple[float, float, float, float]:
    """Inverse of a 2x2 mixing matrix whose columns are first scaled to unit length."""
    n1, n2 = math.hypot(a11, a21) + eps, math.hypot(a12, a22) + eps
    a, b, c, d = a11 / n1, a12 / n2, a21 / n1, a22 / n2
    det = a * d - c * b + eps
    return d / det, -b / det, -c / det, a / det


def unmix(first: Column, second: Column, inverse) -> tuple[Column, Column]:
    """Two unmixed channels: not below zero, truncated to whole numbers."""
    a, b, c, d = map(float, inverse)
    clip = lambda v: F.floor(F.greatest(F.lit(0.0), v)).cast("int")
    return clip(first * F.lit(a) + second * F.lit(b)), clip(first * F.lit(c) + second * F.lit(d))


def above(i: Column, th) -> Column:
    return F.when(i >= th, 1).otherwise(0)


def rotated_position(pos: Column, n: int) -> Column:
    """180-degree rotation: reverse raster order."""
    return F.lit(n - 1) - pos


def shifted(x: Column, by: int, width: int) -> Column:
    """Circular shift of a coordinate."""
    return F.pmod(x + F.lit(by), F.lit(width))


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def grid_cell(x: Column, y: Column, width: float, height: float, n: int) -> tuple[Column, Column]:
    """(row, col) of a point in an n x n grid over the frame."""
    return F.floor(y / F.lit(height / n)).cast("int"), F.floor(x / F.lit(width / n)).cast("int")


def channel_name(path: Column) -> Column:
    """The three characters before the last dot, with bin or bg after masks' and backgrounds' files."""
    base = F.regexp_extract(path, r"(.{3})\.[^.]*$", 1)
    return F.concat(base, F.when(path.contains("/bin_"), "bin").when(path.contains("/bg_"), "bg").otherwise(""))


def empty(width: int, height: int) -> Column:
    """A frame of zeros."""
    return F.array_repeat(F.lit(0), width * height)


def padded(px: Column, width: int, height: int, before: int, after: int) -> Column:
    """A raster array with zeros around it: ``before`` rows and columns first, ``after`` last."""
    row = lambda y: F.concat(F.array_repeat(F.lit(0), before), F.slice(px, y * width + 1, width), F.array_repeat(F.lit(0), after))
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), row))
    wide = width + before + after
    return F.concat(F.array_repeat(F.lit(0), before * wide), rows, F.array_repeat(F.lit(0), after * wide))
