"""Running a study: cells rendered, detected and written shard by shard, resumed where shards are there already."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.functions.identity import number_token
from lumenspark.operators import frames as R
from lumenspark.operators import kernels as K
from lumenspark.operators.conditions import Condition
from lumenspark.sources import shards

#: A detector takes letterboxed images and gives for each one boxes (x1, y1, x2, y2), sparse labels and scores.
Detector = Callable[[list[np.ndarray]], list[dict[str, list]]]
FLOOR, CAP = 0.001, 100


@contextmanager
def locked(folder: str | Path, alone: bool = False) -> Iterator[None]:
    """Many may run in a folder, one alone may analyse it."""
    import fcntl

    Path(folder).mkdir(parents=True, exist_ok=True)
    with open(Path(folder) / ".lock", "a") as f:
        fcntl.flock(f, (fcntl.LOCK_EX if alone else fcntl.LOCK_SH) | fcntl.LOCK_NB)
        yield


def best(output: dict[str, list], cap: int = CAP, floor: float = FLOOR) -> dict[str, list]:
    """Scores from the floor up, the best first, equal ones in their order, and no more than the cap."""
    scores = np.asarray(output["scores"], float)
    order = np.argsort(-scores, kind="stable")
    order = order[scores[order] >= floor][:cap]
    return {"boxes": np.asarray(output["boxes"], float).reshape(-1, 4)[order].tolist(), "labels": [int(output["labels"][i]) for i in order], "scores": scores[order].tolist()}


def native(output: dict[str, list], fit: dict[str, float], height: int, width: int) -> dict[str, list]:
    """Boxes back on the image, clipped; those left without area go."""
    boxes = np.asarray(output["boxes"], float).reshape(-1, 4)
    boxes[:, [0, 2]] = np.clip((boxes[:, [0, 2]] - fit["left"]) / fit["scale_x"], 0, width)
    boxes[:, [1, 3]] = np.clip((boxes[:, [1, 3]] - fit["top"]) / fit["scale_y"], 0, height)
    keep = (boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1])
    return {"boxes": boxes[keep].tolist(), "labels": [x for x, k in zip(output["labels"], keep, strict=True) if k], "scores": [x for x, k in zip(output["scores"], keep, strict=True) if k]}


def run_condition(images: DataFrame, profile: R.Profile, condition: Condition, detect: Detector, folder: str, name: str, shard: int = 250, side: int = 640) -> list[dict]:
    """Receipts of all shards of one condition over ``images`` (frames with an ordinal); a whole shard is not made again.

    A shard's images are one bounded batch: rendered and detected in tasks, collected in order and written once.
    """
    severity = condition.severity()
    out = []
    with locked(folder):
        ids = [r.image_id for r in images.select("image_id", "ordinal").orderBy("ordinal").collect()]
        for k, at in enumerate(range(0, len(ids), shard)):
            own = ids[at : at + shard]
            path = Path(folder) / f"{name}-{k:05d}.jsonl.gz"
            there = shards.existing(path)
            if there is None:
                batch = images.where(F.col("image_id").isin(own))
                shown = batch if severity is None else R.render_ldr(batch, profile, severity)
                found = {r.image_id: {"boxes": r.boxes, "labels": r.labels, "scores": r.scores} for r in _detected(shown, detect, side).collect()}
                there = shards.write(path, shards.header({"condition": condition.record(), "name": name}, own), {i: {"boxes": [list(b) for b in found[i]["boxes"]], "labels": list(found[i]["labels"]), "scores": list(found[i]["scores"])} for i in own})
            out.append(there)
    return out


def _detected(images: DataFrame, detect: Detector, side: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = list(part.itertuples(index=False))
            arrays = [np.asarray(r.data, float).reshape(r.height, r.width, r.channels) for r in rows]
            fits = [K.letterboxed(a, side, side) for a in arrays]
            made = detect([f[0] for f in fits])
            if len(made) != len(rows):
                raise ValueError("a detector gives one output for each image")
            done = [native(best(m), f[1], r.height, r.width) for m, f, r in zip(made, fits, rows, strict=True)]
            yield pd.DataFrame({"image_id": [r.image_id for r in rows], **{c: [d[c] for d in done] for c in ("boxes", "labels", "scores")}})

    return images.select("image_id", "height", "width", "channels", "data").mapInPandas(run, "image_id bigint, boxes array<array<double>>, labels array<bigint>, scores array<double>")


def shard_name(detector: str, profile: str, arm: str, waves: float | None = None) -> str:
    return "-".join([detector, profile, arm if waves is None else f"{arm}_w_{number_token(waves)}"])
