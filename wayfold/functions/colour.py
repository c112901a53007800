"""Colours as column expressions: sRGB, linear light, XYZ (D65) and CIELAB; fixed values are those of the standards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Linear sRGB to XYZ, and the white point.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def linear(c: Column) -> Column:
    """An sRGB component from 0 to 1 as linear light."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def encoded(c: Column) -> Column:
    """Linear light from 0 to 1 as an sRGB component."""
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB (L, a, b) of sRGB components from 0 to 1."""
    light = [linear(c) for c in (r, g, b)]
    f = []
    for row, white in zip(XYZ, WHITE, strict=True):
        t = sum(k * c for k, c in zip(row, light, strict=True)) / white
        f.append(F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def from_lab(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """sRGB components of CIELAB, cut to what a screen shows: 0 to 1."""
    fy = (lightness + 16) / 116
    out = []
    for f, white in zip((fy + a / 500, fy, fy - b / 200), WHITE, strict=True):
        out.append(white * F.when(f * f * f > 216 / 24389, f * f * f).otherwise((116 * f - 16) * 27 / 24389))
    rows = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
    lights = [sum(k * c for k, c in zip(row, out, strict=True)) for row in rows]
    return tuple(encoded(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))) for c in lights)
