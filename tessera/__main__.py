"""python -m tessera scan FOLDER | convert FOLDER OUTPUT [--preset P] | watch FOLDER OUTPUT CHECKPOINT"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main() -> int:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (("scan", ["folder"]), ("convert", ["folder", "output"]), ("watch", ["folder", "output", "checkpoint"])):
        q = sub.add_parser(name)
        for a in args:
            q.add_argument(a)
        q.add_argument("--preset", default="balanced", choices=["fast", "balanced", "maximum"])
        q.add_argument("--backend", default="fallback")
    a = p.parse_args()
    from tessera.operators import dataset
    from tessera.plans.convert import Settings
    from tessera.sources.images import scan
    from tessera.streaming.convert import convert, convert_stream

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    settings = Settings(preset=a.preset, backend=a.backend)
    if a.command == "scan":
        data = scan(spark, a.folder)
        counts = dataset.summary(data.images, data.annotations, data.issues, "relative_image").first().asDict()
        print(json.dumps(counts | {"names": data.names}, indent=2))
        for r in data.issues.orderBy(F.col("relative_image").asc_nulls_first(), "line_no").limit(50).collect():  # a report's head
            print(r.relative_image or "DATASET", r.issue)
        return 1 if counts["problems"] else 0
    if a.command == "convert":
        print(json.dumps(convert(spark, a.folder, a.output, settings), indent=2, default=str))
        return 0
    convert_stream(spark, a.folder, a.output, a.checkpoint, settings, {"processingTime": "10 seconds"}).awaitTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
