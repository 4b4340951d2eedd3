"""Factorial plans: profiles x arms, the cells that each detector takes, legal stage graphs and evidence tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspark.functions.identity import canonical_array, canonical_long, canonical_map, canonical_text, digest, number_token

#: Fixed values of the published grid: defocus in waves, the anchors that every detector takes, and the names.
WAVES = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
ANCHORS = (0.5, 1.5, 3.0)
PROFILES = ("primary", "replication")
BASELINES = ("untouched_input", "modeled_neutral")
COMPARATORS = ("gaussian", "quadratic_cosine", "sampled_incoherent")
ALL_ARMS, ANCHOR_ARMS = "all_arms", "baselines_and_physical_anchors"
#: The domains that an image passes, in the two ways of making one.
LDR = ("display_rgb", "linear_rgb_proxy", "source_grid_linear_rgb", "linear_rgb_optical", "photosite_expectation", "electrons", "adc_dn", "signed_camera_linear", "output_linear_rgb_signed", "nonnegative", "tone_mapped", "output_gamut", "display_rgb", "detector_input")
FORWARD = ("scene_spectral", "instantaneous_scene_projection", "optical_sensor_irradiance", "photosite_expectation", "electrons", "raw_adc_dn", "signed_camera_linear", "camera_linear_rgb", "output_linear_rgb_signed", "nonnegative", "tone_mapped", "output_gamut", "display_rgb", "detector_input")
SHORT_CUTS = {"ldr": (("linear_rgb_optical", "output_linear_rgb_signed"),), "forward": (("scene_spectral", "photosite_expectation"),)}


@dataclass(frozen=True)
class Allocation:
    """What a detector takes: its profiles, and all arms or baselines and physical arms at some anchors."""

    detector: str
    profiles: tuple[str, ...] = PROFILES[:1]
    policy: str = ANCHOR_ARMS
    anchors: tuple[float, ...] = ANCHORS


def arms(spark: SparkSession, profiles: tuple[str, ...] = PROFILES, waves: tuple[float, ...] = WAVES, comparators: tuple[str, ...] = COMPARATORS) -> DataFrame:
    """(profile_id, arm_id, family, kind, waves, ordinal): baselines, then for each defocus the physical arm and its comparators."""
    rows = [(b, "baseline", b, None) for b in BASELINES]
    for w in waves:
        rows.append((f"physical_w_{number_token(w)}", "physical_defocus", "physical", float(w)))
        rows += [(f"comparator_{c}_w_{number_token(w)}", "mechanism_comparator", c, float(w)) for c in sorted(comparators, key=str.encode)]
    per = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "arm_id string, family string, kind string, waves double, ordinal int")
    names = spark.createDataFrame([(p, i) for i, p in enumerate(profiles)], "profile_id string, profile_ordinal int")
    made = names.crossJoin(per)  # both are the plan's own constants
    identity = canonical_map({"arm": canonical_text(F.col("arm_id")), "family": canonical_text(F.col("family")), "profile": canonical_text(F.col("profile_id"))})
    return made.withColumn("condition_sha256", digest(identity))


def accepted(arm_rows: DataFrame, allocations: list[Allocation]) -> DataFrame:
    """(detector_id, arm columns): the cells, in order of detector, profile and arm, with their digests."""
    spark = arm_rows.sparkSession
    rows = [(a.detector, p, a.policy, list(a.anchors), i) for i, a in enumerate(allocations) for p in a.profiles]
    wanted = spark.createDataFrame(rows, "detector_id string, profile_id string, policy string, anchors array<double>, detector_ordinal int")
    takes = (F.col("policy") == ALL_ARMS) | (F.col("family") == "baseline") | ((F.col("family") == "physical_defocus") & F.array_contains("anchors", F.col("waves")))
    cells = wanted.join(arm_rows, "profile_id").where(takes)
    place = F.row_number().over(Window.orderBy("detector_ordinal", "profile_ordinal", "ordinal")) - 1  # a plan's cells are few
    identity = canonical_map({"detector_id": canonical_text(F.col("detector_id")), "profile_id": canonical_text(F.col("profile_id")), "arm_id": canonical_text(F.col("arm_id")), "condition_sha256": canonical_text(F.col("condition_sha256"))})
    return cells.withColumn("cell_ordinal", place.cast("int")).withColumn("cell_sha256", digest(identity)).select("detector_id", "profile_id", "arm_id", "family", "kind", "waves", "condition_sha256", "cell_ordinal", "cell_sha256")


def publication_cells(spark: SparkSession, detectors: tuple[str, ...] = ("first", "second", "third", "fourth")) -> DataFrame:
    """The published plan: the first detector takes every arm of both profiles, the others the anchors of one."""
    allocations = [Allocation(detectors[0], PROFILES, ALL_ARMS), *[Allocation(d) for d in detectors[1:]]]
    return accepted(arms(spark), allocations)


def curve_cells(cells: DataFrame, detector: str, profile: str, comparator: str = "gaussian") -> DataFrame:
    """(waves, physical, comparator): the pair of cells at each coordinate; a coordinate without just one of each is an error."""
    own = cells.where((F.col("detector_id") == detector) & (F.col("profile_id") == profile) & F.col("waves").isNotNull())
    pairs = own.groupBy("waves").agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("cell_sha256"))).alias(n) for k, n in (("physical", "physical"), (comparator, "comparator"))])
    one = lambda c: F.when(F.size(c) == 1, F.col(c)[0]).otherwise(F.raise_error(F.lit(f"a coordinate needs just one {c} cell")))
    return pairs.select("waves", one("physical").alias("physical"), one("comparator").alias("comparator"))


def transitions(spark: SparkSession) -> DataFrame:
    """(mode, source, target) of every legal edge; an edge within a domain of the mode is legal too."""
    rows = set()
    for mode, line in (("ldr", LDR), ("forward", FORWARD)):
        rows |= {(mode, a, b) for a, b in zip(line, line[1:], strict=False)} | {(mode, d, d) for d in line} | {(mode, *p) for p in SHORT_CUTS[mode]}
    return spark.createDataFrame(sorted(rows), "mode string, source string, target string")


def illegal_stages(stages: DataFrame, legal: DataFrame) -> DataFrame:
    """Stages (pipeline, mode, idx, input_domain, output_domain, input_units, output_units) with ``problem``: an edge that
    isn't legal, or an input that isn't the last stage's output."""
    line = Window.partitionBy("pipeline").orderBy("idx")
    joined = stages.withColumn("_domain", F.lag("output_domain").over(line)).withColumn("_units", F.lag("output_units").over(line)).withColumn("_first", F.row_number().over(line) == 1)
    known = legal.select(F.col("mode"), F.col("source").alias("input_domain"), F.col("target").alias("output_domain"), F.lit(True).alias("_legal"))
    joined = joined.join(F.broadcast(known), ["mode", "input_domain", "output_domain"], "left")  # a fixed table
    problem = F.when(F.col("_legal").isNull(), "illegal edge").when(~F.col("_first") & (F.col("_domain") != F.col("input_domain")), "domain breaks").when(~F.col("_first") & (F.col("_units") != F.col("input_units")), "units break")
    return joined.withColumn("problem", problem).where("problem is not null").select(*stages.columns, "problem")


def completion(cells: DataFrame, predictions: DataFrame, images: int) -> DataFrame:
    """Cells (cell_sha256) that don't have one prediction row for each image: their count, and ``problem``."""
    counts = predictions.groupBy("cell_sha256").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("image_id").alias("images"))
    joined = cells.select("cell_sha256").join(counts, "cell_sha256", "full_outer").join(cells.select("cell_sha256", F.lit(True).alias("_planned")), "cell_sha256", "left")
    problem = F.when(F.col("_planned").isNull(), "not planned").when(F.col("rows").isNull(), "missing").when(F.col("rows") != F.col("images"), "repeated image").when(F.col("images") != images, "incomplete")
    return joined.withColumn("problem", problem).where("problem is not null").select("cell_sha256", "rows", "images", "problem")


def tier(checks: dict[str, Column]) -> tuple[Column, Column]:
    """All checks as one record, and the tier that they earn together."""
    record = F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    every = F.lit(True)
    for c in checks.values():
        every = every & F.coalesce(c, F.lit(False))
    return record, F.when(every, "publication_protocol_reproduction").otherwise("exploratory_protocol_variant")


def axis_identity(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group, count, first, last, selection_sha256) of each group's keys in ascending order."""
    lists = rows.groupBy(*group).agg(F.sort_array(F.collect_list(key)).alias("_keys"))
    items = canonical_array(F.transform("_keys", canonical_long))
    return lists.select(*group, F.size("_keys").cast("bigint").alias("count"), F.col("_keys")[0].alias("first"), F.element_at("_keys", -1).alias("last"), digest(items).alias("selection_sha256"))
