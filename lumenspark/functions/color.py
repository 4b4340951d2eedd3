"""Colour, tone and gamut as column expressions. Every function maps null to null."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sRGB curve and the luminance weights of its primaries.
DECODE_EDGE, ENCODE_EDGE = 0.04045, 0.0031308
SLOPE, OFFSET, SCALE, POWER = 12.92, 0.055, 1.055, 2.4
LUMINANCE = (0.2126, 0.7152, 0.0722)
PIVOT = 0.18


def srgb_decode(code: Column) -> Column:
    """From the display code, 0 to 1, to linear light."""
    return F.when(code <= DECODE_EDGE, code / SLOPE).otherwise(F.pow((code + OFFSET) / SCALE, F.lit(POWER)))


def srgb_encode(linear: Column) -> Column:
    """From linear light, 0 to 1, to the display code."""
    return F.when(linear <= ENCODE_EDGE, linear * SLOPE).otherwise(SCALE * F.pow(linear, F.lit(1 / POWER)) - OFFSET)


@dataclass(frozen=True)
class Colorimetry:
    """A colour space: its primaries and white as (x, y), and the weights of its luminance, positive and of sum 1."""

    name: str = "srgb"
    primaries: tuple[tuple[float, float], ...] = ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06))
    white: tuple[float, float] = (0.3127, 0.3290)
    weights: tuple[float, float, float] = LUMINANCE

    def __post_init__(self) -> None:
        points = (*self.primaries, self.white)
        if not self.name.strip() or len(self.primaries) != 3 or any(len(p) != 2 or not (p[0] >= 0 and p[1] > 0 and sum(p) <= 1) for p in points):
            raise ValueError("a colour space has a name, three primaries and a white within the diagram")
        if len(self.weights) != 3 or not all(0 < w < math.inf for w in self.weights) or abs(sum(self.weights) - 1) > 1e-12:
            raise ValueError("luminance weights are positive and of sum 1")


def luminance(r: Column, g: Column, b: Column) -> Column:
    """The weighted sum, scaled by the largest channel so that it neither over- nor underflows on the way."""
    top = F.greatest(F.abs(r), F.abs(g), F.abs(b))
    scaled = sum((w * F.try_divide(c, top) for w, c in zip(LUMINANCE, (r, g, b), strict=True)), F.lit(0.0))
    return F.when(top == 0, F.lit(0.0)).otherwise(top * scaled)


def gray(r: Column, g: Column, b: Column) -> Column:
    return LUMINANCE[0] * r + LUMINANCE[1] * g + LUMINANCE[2] * b


def clip_negative(value: Column) -> Column:
    """The gamut rule before the tone curve."""
    return F.greatest(value, F.lit(0.0))


def clip_unit(value: Column) -> Column:
    """The gamut rule after the tone curve."""
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def stop_ratio(light: Column, rho: float, pivot: float = PIVOT) -> Column:
    """pivot * (light / pivot) ** rho; 0 stays 0, and rho 1 changes nothing."""
    if rho == 1:
        return light
    return F.when(light > 0, pivot * F.pow(light / pivot, F.lit(rho))).otherwise(F.lit(0.0))


def global_tone(r: Column, g: Column, b: Column, rho: float, pivot: float = PIVOT) -> tuple[Column, Column, Column]:
    """The tone curve on luminance; channels keep their ratios to it."""
    light = luminance(r, g, b)
    mapped = stop_ratio(light, rho, pivot)
    return tuple(F.when(light > 0, mapped * F.try_divide(c, light)).otherwise(F.lit(0.0)) for c in (r, g, b))


def transformed(channels: tuple[Column, Column, Column], balance: tuple[float, float, float], matrix: tuple[tuple[float, float, float], ...]) -> tuple[Column, ...]:
    """White balance, then a 3 x 3 matrix, row by row."""
    balanced = [c * w for c, w in zip(channels, balance, strict=True)]
    return tuple(sum((m * c for m, c in zip(row, balanced, strict=True)), F.lit(0.0)) for row in matrix)


def is_rgb(r: Column, g: Column, b: Column, low: float | None = None, high: float | None = None) -> Column:
    """Whether the three are present, finite and within the bounds."""

    def sound(c: Column) -> Column:
        fine = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        if low is not None:
            fine = fine & (c >= low)
        return fine & (c <= high) if high is not None else fine

    return F.coalesce(sound(r) & sound(g) & sound(b), F.lit(False))
