"""Focus, defocus and closed forms of blur as column expressions. Lengths are in metres, defocus in waves."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the first zero of the Airy pattern, in units of wavelength times f-number.
AIRY_ZERO = 1.2196698912665045


def image_distance(focal: Column, distance: Column) -> Column:
    """Thin lens: f s / (s - f); null unless the object is beyond the focal length."""
    return F.when(distance > focal, focal * distance / (distance - focal))


def edge_waves_from_conjugates(distance: Column, image: Column, focal: Column, radius: Column, wavelength: Column) -> Column:
    return radius * radius * (1 / distance + 1 / image - 1 / focal) / (2 * wavelength)


def offset_from_focal_change(nominal: Column, perturbed: Column, distance: Column) -> Column:
    return image_distance(perturbed, distance) - image_distance(nominal, distance)


def offset_from_distance_change(focal: Column, focused: Column, perturbed: Column) -> Column:
    return image_distance(focal, perturbed) - image_distance(focal, focused)


def edge_waves(offset: Column, f_number: Column, wavelength: Column) -> Column:
    return -offset / (8 * wavelength * f_number * f_number)


def image_offset(waves: Column, f_number: Column, wavelength: Column) -> Column:
    return -8 * wavelength * f_number * f_number * waves


def circle_of_confusion(offset: Column, f_number: Column) -> Column:
    return F.abs(offset) / f_number


def airy_radius(f_number: Column, wavelength: Column) -> Column:
    return AIRY_ZERO * wavelength * f_number


def on_axis_ratio(waves: Column) -> Column:
    """(sin(pi W) / (pi W)) ** 2, and 1 at best focus."""
    return F.when(waves == 0, F.lit(1.0)).otherwise(F.pow(F.try_divide(F.sin(math.pi * waves), math.pi * waves), F.lit(2.0)))


def scaled_defocus(waves: Column, reference: Column, wavelength: Column) -> Column:
    return waves * reference / wavelength


def defocus_phase(radius_squared: Column, waves: Column) -> Column:
    return 2 * math.pi * waves * radius_squared


def aperture(x: Column, y: Column) -> Column:
    return F.when(x * x + y * y <= 1, F.lit(1.0)).otherwise(F.lit(0.0))


def sigma_for_mtf50(frequency: Column) -> Column:
    return math.sqrt(math.log(2)) / (math.sqrt(2) * math.pi * frequency)


def sigma_for_energy(radius: Column, fraction: Column) -> Column:
    return radius / F.sqrt(-2 * F.log1p(-fraction))


def gaussian_mtf(sigma: Column, frequency: Column) -> Column:
    return F.exp(-2 * math.pi**2 * sigma * sigma * frequency * frequency)
