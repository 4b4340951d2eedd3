"""Run manifests, result tables of a study, its built-in cameras, and pipelines that know their provenance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspark.functions.identity import canonical_sha256, json_line
from lumenspark.operators import study
from lumenspark.operators.frames import Profile, dealt, mapped
from lumenspark.operators.intervals import paired, percentile_interval
from lumenspark.operators.selection import numbered_partitions
from lumenspark.sources.publication import csv_bytes

#: Columns of the published tables, in order, and the kinds of estimand.
SECONDARY = ("study_plan_sha256", "detector_id", "profile_id", "arm_id", "baseline_arm_id", "metric", "estimand", "estimate", "lower_95", "upper_95", "confirmatory")
PRIMARY = ("study_plan_sha256", "detector_id", "profile_id", "metric", "estimand", "edge_waves_ref", "estimate", "lower_95", "upper_95", "unit", "confirmatory")
ESTIMANDS = ("marginal", "difference", "ratio")


def run_manifest(cells: DataFrame, images: DataFrame, size: int = 250) -> DataFrame:
    """(cell columns, shard, first_ordinal, image_count, first_image_id, last_image_id): every shard of every cell.

    ``images`` (image_id) are taken in ascending order, each once; without images there are no shards.
    """
    shards = numbered_partitions(images.select("image_id").where("image_id is not null").distinct(), "image_id", size)
    ends = shards.groupBy("shard").agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("image_count"), F.min("image_id").alias("first_image_id"), F.max("image_id").alias("last_image_id"))
    # every cell runs every shard: this product is the plan itself; a plan's cells are a fixed few
    return ends.join(F.broadcast(cells))


def secondary_table(replicates: DataFrame, points: DataFrame, baseline: str, about: dict[str, str]) -> DataFrame:
    """SECONDARY rows of each arm, metric and estimand: estimates from ``points`` (arm, metric, value), 95 % percentile
    intervals from ``replicates`` (arm, replicate, metric, value), both against the baseline arm's same replicate.

    ``about`` has the plan's digest, detector and profile. A ratio whose baseline isn't positive everywhere has no interval.
    """
    kinds = dict(zip(ESTIMANDS, ("value", "difference", "ratio"), strict=True))
    long = lambda: F.explode(F.array(*[F.struct(F.lit(k).alias("estimand"), F.col(c).alias("v")) for k, c in kinds.items()])).alias("k")
    each = paired(replicates, "arm", ["replicate", "metric"], "value", baseline).select("arm", "metric", long()).select("arm", "metric", "k.estimand", "k.v")
    whole = each.groupBy("arm", "metric", "estimand").agg((F.count("v") == F.count(F.lit(1))).alias("defined"))
    ends = percentile_interval(each, ["arm", "metric", "estimand"], "v").join(whole, ["arm", "metric", "estimand"])
    found = paired(points, "arm", ["metric"], "value", baseline).select("arm", "metric", long()).select("arm", "metric", "k.estimand", F.col("k.v").alias("estimate")).join(ends, ["arm", "metric", "estimand"], "left")
    own = {"arm_id": F.col("arm"), "baseline_arm_id": F.lit(baseline), "lower_95": F.when(F.col("defined"), F.col("lower")), "upper_95": F.when(F.col("defined"), F.col("upper")), "confirmatory": F.lit(False)}
    return found.select(*[(own[c] if c in own else F.lit(about[c]) if c in about else F.col(c)).alias(c) for c in SECONDARY])


def primary_table(curves: DataFrame, replicates: DataFrame, about: dict[str, str], confirmatory: str = "map50_95") -> DataFrame:
    """PRIMARY rows of a curve contrast: the gap at each coordinate, and the area between the curves by trapezoids.

    ``curves`` (metric, waves, physical, comparator) are points; ``replicates`` has the replicate beside them.
    """
    def estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
        line, gap = Window.partitionBy(*keys).orderBy("waves"), F.col("physical") - F.col("comparator")
        rows = rows.withColumn("gap", gap).withColumn("piece", (F.col("gap") + F.lag("gap").over(line)) / 2 * (F.col("waves") - F.lag("waves").over(line)))
        area = rows.groupBy(*keys).agg(F.coalesce(F.sum("piece"), F.lit(0.0)).alias("v")).select(*keys, F.lit("curve_auc").alias("estimand"), F.lit(None).cast("double").alias("edge_waves_ref"), "v")
        return rows.select(*keys, F.lit("point_difference").alias("estimand"), F.col("waves").alias("edge_waves_ref"), F.col("gap").alias("v")).unionByName(area)

    place = ["metric", "estimand", "_at"]
    at = F.coalesce(F.col("edge_waves_ref").cast("string"), F.lit("")).alias("_at")
    ends = percentile_interval(estimates(replicates, ["replicate", "metric"]).select("*", at), place, "v")
    found = estimates(curves, ["metric"]).select("metric", "estimand", "edge_waves_ref", F.col("v").alias("estimate"), at).join(ends, place, "left")
    area = F.col("estimand") == "curve_auc"
    own = {"lower_95": F.col("lower"), "upper_95": F.col("upper"), "unit": F.when(area, "metric_waves").otherwise("metric"), "confirmatory": area & (F.col("metric") == confirmatory)}
    return found.select(*[(own[c] if c in own else F.lit(about[c]) if c in about else F.col(c)).alias(c) for c in PRIMARY])


def secondary_csv(rows: DataFrame) -> bytes:
    return csv_bytes(rows.select(*SECONDARY), ["detector_id", "profile_id", "arm_id", "metric", "estimand"])


def primary_csv(rows: DataFrame) -> bytes:
    return csv_bytes(rows.select(*PRIMARY), ["detector_id", "profile_id", "metric", "estimand", "edge_waves_ref"])


def profiles() -> dict[str, Profile]:
    """The built-in synthetic cameras. None is a measured one; the replication samples its optics twice as finely."""
    base = Profile(
        reach=1.2, reference_electrons=4096.0, full_well=16000.0, read_noise=2.2, dark_rate=0.15, efficiency=(0.48, 0.60, 0.42), conversion=0.25, black=256.0, bits=14, exposure=5e-3, line_time=1e-5, focal_px=15.0, sensor=(8, 10)
    )
    native = replace(base, sensor=(640, 640), line_time=0.0)
    return {"ldr": base, "ldr_pilot": replace(base, sensor=(120, 160), focal_px=200.0), "ldr_native": native, "ldr_native_replication": replace(native, f_number=5.6, pitch=2.8e-6)}


def profile_rows(spark: SparkSession) -> DataFrame:
    """(profile_id, height, width, pitch_um, f_number, sampling, first_zero_px, sha256) of the built-in cameras."""
    rows = []
    for name, p in profiles().items():
        sampling = p.f_number * p.reference / p.pitch
        rows.append((name, *p.sensor, p.pitch * 1e6, p.f_number, sampling, 2 * 1.2196698912665045 * sampling, canonical_sha256(asdict(p))))
    return spark.createDataFrame(rows, "profile_id string, height int, width int, pitch_um double, f_number double, sampling double, first_zero_px double, sha256 string")


@dataclass(frozen=True)
class Stage:
    """One step: from a domain to another, by a function of (image id, array); what it was made with is its provenance."""

    name: str
    source: str
    target: str
    fn: Callable[[int, np.ndarray], np.ndarray]
    made_with: tuple[tuple[str, object], ...] = ()

    def record(self) -> dict:
        return {"name": self.name, "input_domain": self.source, "output_domain": self.target, "parameters": {k: v for k, v in self.made_with}}


@dataclass(frozen=True)
class Pipeline:
    """Stages whose domains meet and are legal edges of the mode, checked when it is made."""

    mode: str
    stages: tuple[Stage, ...]

    def __post_init__(self) -> None:
        line = study.LDR if self.mode == "ldr" else study.FORWARD
        legal = {*zip(line, line[1:], strict=False), *((d, d) for d in line), *study.SHORT_CUTS[self.mode]}
        if not self.stages or any((s.source, s.target) not in legal for s in self.stages):
            raise ValueError("a pipeline has legal stages, one at least")
        if any(a.target != b.source for a, b in zip(self.stages, self.stages[1:], strict=False)) or len({s.name for s in self.stages}) != len(self.stages):
            raise ValueError("a stage takes what the one before it gives, and has a name of its own")

    def provenance_json(self) -> bytes:
        """One canonical line: the mode, each stage, and the digest of both."""
        record = {"mode": self.mode, "stages": [s.record() for s in self.stages]}
        return json_line(record | {"signature_sha256": canonical_sha256(record)})

    def run(self, frames: DataFrame) -> DataFrame:
        """Frames through all stages in one pass of each image."""
        steps = [s.fn for s in self.stages]

        def one(key: int, image: np.ndarray) -> np.ndarray:
            for step in steps:
                image = step(key, image)
            return image

        return mapped(dealt(frames), one)

    def trace(self, frames: DataFrame) -> dict[str, DataFrame]:
        """What each stage gives, by its name."""
        return {s.name: Pipeline(self.mode, self.stages[: i + 1]).run(frames) for i, s in enumerate(self.stages)}


def source_to_sensor(source: tuple[int, int], sensor: tuple[int, int]) -> np.ndarray:
    """Sample centres of a source grid to those of the sensor over the same field: x' = (x + 1/2) w' / w - 1/2."""
    sy, sx = sensor[0] / source[0], sensor[1] / source[1]
    return np.array([[sx, 0, (sx - 1) / 2], [0, sy, (sy - 1) / 2], [0, 0, 1.0]])


def homography_on_source(sensor_homography: np.ndarray, source: tuple[int, int], sensor: tuple[int, int]) -> np.ndarray:
    """A homography of sensor coordinates as one of source coordinates."""
    there = source_to_sensor(source, sensor)
    return np.linalg.inv(there) @ sensor_homography @ there

