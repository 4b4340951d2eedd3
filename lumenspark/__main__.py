"""Command line: the plan's cells, its evidence, or the metrics of a folder of shards."""

from __future__ import annotations

import argparse

from lumenspark.session import session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumenspark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("plan", help="print the cells of the published plan")
    commands.add_parser("evidence", help="print the numerical evidence; fails if a tolerance is passed")
    analyze = commands.add_parser("analyze", help="publish the metrics of shards against annotations")
    analyze.add_argument("annotations")
    analyze.add_argument("shards")
    analyze.add_argument("out")
    chosen = parser.parse_args(args)
    spark = session()
    if chosen.command == "plan":
        from lumenspark.operators.study import publication_cells

        for r in publication_cells(spark).orderBy("cell_ordinal").collect():
            print(r.cell_ordinal, r.detector_id, r.profile_id, r.arm_id, r.cell_sha256)
        return 0
    if chosen.command == "evidence":
        from lumenspark.operators.evidence import report
        from lumenspark.operators.frames import Profile

        rows = report(spark, Profile()).orderBy("severity", "channel", "metric").collect()
        for r in rows:
            print(r.severity, r.channel, r.metric, f"{r.value:.3g}", f"<= {r.tolerance:g}", "passed" if r.passed else "FAILED")
        return int(not all(r.passed for r in rows))
    from lumenspark.operators import detection
    from lumenspark.operators.execution import locked
    from lumenspark.sources import coco, publication, shards

    with locked(chosen.shards, alone=True):
        truth = coco.read_annotations(spark, chosen.annotations)
        found = shards.detections(shards.read(spark, f"{chosen.shards}/*.gz*"))
        made = detection.metrics(detection.accumulated(detection.matches(truth.gt, found.drop("study"))), truth.categories)
        publication.publish(chosen.out, {"points.csv": publication.csv_bytes(made, ["metric", "category_id"])}, {"annotations": chosen.annotations})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
