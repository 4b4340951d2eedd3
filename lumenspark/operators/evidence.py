"""Numerical evidence: kernels against closed forms and finer samplings, one task for each severity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lumenspark.functions.identity import canonical_sha256
from lumenspark.operators import kernels as K
from lumenspark.operators.frames import Profile

#: The tolerances, and the ladder of samplings (pupil samples, transform size, reach of the grid).
TOLERANCE = {"flux": 5e-12, "symmetry": 5e-12, "mtf_linf": 0.005, "mtf50_relative": 0.01, "contraction": 0.75, "match_relative": 0.005, "quadrature": 2e-8, "retained_energy": 5e-9, "formation": 5e-13, "airy_centre": 1e-3, "airy": 5e-4, "aperture_mtf": 1.2e-3, "convolution": 2e-13, "dct_envelope": 1e-9}
LADDER = {"coarse": (65, 257), "declared": (129, 513), "refined": (257, 1025)}

SCHEMA = "severity double, channel int, metric string, value double, tolerance double, passed boolean"


def _row(waves: float, channel: int, metric: str, value: float, limit: str | None = None) -> tuple:
    most = TOLERANCE[limit or metric]
    return waves, channel, metric, float(value), most, bool(value <= most)


def _channel(profile: Profile, waves: float, channel: int) -> Iterator[tuple]:
    wavelength = profile.wavelengths[channel]
    spreads = {n: K.point_spread(K.pupil(p, waves * profile.reference / wavelength), wavelength, profile.f_number, t) for n, (p, t) in LADDER.items()}
    cells = {n: K.cell_average(s, profile.pitch) for n, s in spreads.items()}
    own = spreads["declared"]
    yield _row(waves, channel, "flux", abs(own.values.sum() * own.spacing**2 - 1))
    v = cells["declared"].values
    yield _row(waves, channel, "symmetry", max(np.abs(v - w).max() for w in (v[::-1], v[:, ::-1], v.T)))
    curves = {n: K.kernel_mtf(c.values, samples=513) for n, c in cells.items()}
    gap = {n: np.abs(curves[n][1] - curves["refined"][1]).max() for n in ("coarse", "declared")}
    yield _row(waves, channel, "mtf_linf", gap["declared"])
    yield _row(waves, channel, "contraction", gap["declared"] / gap["coarse"] if gap["coarse"] > 1e-12 else 0.0)
    half = {n: K.crossing(*c) for n, c in curves.items()}
    if half["declared"] and half["refined"]:
        yield _row(waves, channel, "mtf50_relative", abs(half["declared"] / half["refined"] - 1))
    fine = 1 << 14  # the tent by midpoints against its closed form
    edges = own.axis[:, None] + (np.arange(fine) + 0.5) / fine * own.spacing - own.spacing / 2
    midpoint = np.maximum(0, profile.pitch - np.abs(edges)).mean(axis=1) * own.spacing
    exact = K.tent_integral(own.axis + own.spacing / 2, profile.pitch) - K.tent_integral(own.axis - own.spacing / 2, profile.pitch)
    yield _row(waves, channel, "quadrature", np.abs(midpoint - exact).max() / profile.pitch**2)
    # the share of energy that the cut keeps, again by sums over the uncut cells
    whole = K.cell_average(own, profile.pitch, 1.0).values
    middle, half = len(whole) // 2, len(v) // 2
    square = slice(middle - half, middle + half + 1)
    yield _row(waves, channel, "retained_energy", abs(whole[square, square].sum() / whole.sum() - cells["declared"].retained))
    if waves == 0:
        finest = spreads["refined"]
        middle = len(finest.values) // 2
        near = slice(middle - 10, middle + 11)
        y, x = np.meshgrid(finest.axis[near], finest.axis[near], indexing="ij")
        airy = K.airy_density(np.hypot(x, y), wavelength, profile.f_number)
        peak = finest.values[middle, middle]
        yield _row(waves, channel, "airy_centre", abs(peak / airy.max() - 1))
        yield _row(waves, channel, "airy", np.abs(finest.values[near, near] / peak - airy / airy.max()).max())
        f, m = K.axis_mtf(finest)
        inside = f < 1 / (wavelength * profile.f_number)
        yield _row(waves, channel, "aperture_mtf", np.abs(m[inside] - K.circular_mtf(f[inside], wavelength, profile.f_number)).max())


def _comparators(profile: Profile, waves: float) -> Iterator[tuple]:
    """A Gaussian after best focus that crosses one half where the defocused optics do."""
    light = np.array([0.2126, 0.7152, 0.0722])

    def mixed(kernels: list[np.ndarray]) -> np.ndarray:
        n = max(len(k) for k in kernels)
        return sum(w * np.pad(k, (n - len(k)) // 2) for w, k in zip(light, kernels, strict=True))

    neutral, defocused = (K.kernel_mtf(mixed(profile.kernels(w))) for w in (0.0, waves))
    target = K.crossing(*defocused)
    if waves == 0 or target is None:
        return
    measure = lambda kernel: K.crossing(neutral[0], neutral[1] * K.kernel_mtf(kernel)[1])
    sigma = K.root(lambda s: (measure(K.gaussian_kernel(s)) or 0.5) - target, 0.05, 12.0, 1e-9)
    yield _row(waves, -1, "match_relative", abs(measure(K.gaussian_kernel(sigma)) / target - 1))
    alpha = math.acos(min(1.0, 0.5 / np.interp(target, *neutral))) / (2 * target**2)
    line = np.cos(alpha * np.linspace(0, 0.5, 2049) ** 2 / 0.5) * neutral[1]
    yield _row(waves, -1, "match_relative", abs(K.crossing(neutral[0], line) / target - 1))
    for n in (145, 640):  # a wave on the finite grid passes the cosine response unchanged but for its factor
        k = round(2 * (n - 1) * target)
        wave = np.cos(np.pi * k * np.arange(n) / (n - 1))[None, :]
        got = K.quadratic_cosine(np.repeat(wave, 3, axis=0), alpha)[0]
        yield _row(waves, n, "dct_envelope", np.abs(got - wave[0] * math.cos(alpha * (k / (2 * (n - 1))) ** 2 / 0.5)).max())


def _independent() -> Iterator[tuple]:
    rng = np.random.default_rng(7)
    image, kernel = rng.random((19, 23)), rng.random((5, 3))
    yield _row(-1.0, -1, "convolution", np.abs(K.convolved(image, kernel) - K.convolved(image, kernel, direct=True)).max())
    # formation on equal grids: every sample a loop over its reflected neighbours
    own = np.zeros(image.shape)
    for y, x, i, j in np.ndindex(*image.shape, *kernel.shape):
        at = [abs(p) if p < n else 2 * n - 2 - p for p, n in ((y + kernel.shape[0] // 2 - i, image.shape[0]), (x + kernel.shape[1] // 2 - j, image.shape[1]))]
        own[y, x] += kernel[i, j] * image[tuple(at)]
    yield _row(-1.0, -1, "formation", np.abs(K.convolved(image, kernel) - own).max())


def report(spark: SparkSession, profile: Profile, severities: tuple[float, ...] = (0.0, 0.5)) -> DataFrame:
    """(severity, channel, metric, value, tolerance, passed): each severity and channel is a row that any task can take."""
    jobs = [(w, c) for w in severities for c in (*range(3), -1)] + [(-1.0, -2)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for w, c in part.itertuples(index=False):
                made = _independent() if c == -2 else _comparators(profile, w) if c == -1 else _channel(profile, w, c)
                yield pd.DataFrame(list(made), columns=["severity", "channel", "metric", "value", "tolerance", "passed"])

    rows = spark.createDataFrame(jobs, "severity double, channel int").repartition(len(jobs))
    return rows.mapInPandas(run, SCHEMA)


MATCHES = "family string, waves double, target_mtf50 double, neutral_at_target double, parameter double, achieved_mtf50 double, relative_error double, config_sha256 string"


def _bracket(f: Callable[[float], float], step: float, factor: float) -> tuple[float, float]:
    """The first two values between which a response falls to its target: steps that grow by the factor, or equal ones."""
    low, high = 0.0, step
    while f(high) > 0:
        low, high = high, high * factor if factor > 1 else high + step
        if high > 512:
            raise ValueError("no strength up to 512 reaches the target")
    return low, high


def matched(profile: Profile, waves: float, size: int = 257, fraction: float = 0.999) -> Iterator[tuple]:
    """The three comparators which, after best focus, cross one half where the defocused optics do."""
    if waves <= 0:
        raise ValueError("a match needs defocus")
    light = np.array([0.2126, 0.7152, 0.0722])

    def mixed(kernels: list[np.ndarray]) -> np.ndarray:
        n = max(len(k) for k in kernels)
        return sum(w * np.pad(k, (n - len(k)) // 2) for w, k in zip(light, kernels, strict=True))

    (f, neutral), defocused = (K.kernel_mtf(mixed(profile.kernels(w))) for w in (0.0, waves))
    target = K.crossing(*defocused)
    if target is None:
        raise ValueError("the target lies beyond the sampling limit")
    before = float(np.interp(target, f, neutral))
    responses = {
        "gaussian": lambda v: np.interp(f, *K.kernel_mtf(K.gaussian_kernel(v))),
        "quadratic_cosine": lambda v: np.cos(2 * v * f**2),
        "sampled_incoherent": lambda v: np.interp(f, *K.kernel_mtf(K.incoherent_kernel(v, size, fraction))),
    }
    for family, response in responses.items():
        if family == "quadratic_cosine":
            strength = math.acos(0.5 / before) / (2 * target**2)
        else:
            short = lambda v, r=response: before * float(np.interp(target, f, r(v))) - 0.5
            strength = K.root(short, *_bracket(short, 0.25, 2.0 if family == "gaussian" else 1.0))
        got = K.crossing(f, neutral * response(strength))
        config = {"family": family, "parameter": strength} | ({"size": size, "fraction": fraction} if family == "sampled_incoherent" else {})
        yield family, waves, target, before, strength, got, abs(got / target - 1), canonical_sha256(config)


def match_grid(spark: SparkSession, profile: Profile, waves: tuple[float, ...]) -> DataFrame:
    """MATCHES of each severity, which are different and one at least: one task a severity."""
    if not waves or len(set(waves)) != len(waves):
        raise ValueError("severities are different, one at least")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for w in part["waves"]:
                yield pd.DataFrame(list(matched(profile, float(w))), columns=[c.split()[0] for c in MATCHES.split(", ")])

    return spark.createDataFrame([(float(w),) for w in waves], "waves double").repartition(len(waves)).mapInPandas(run, MATCHES)
