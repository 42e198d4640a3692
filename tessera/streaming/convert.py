"""Batch and incremental conversion of a folder.

A conversion runs in rounds. Each round writes what it has read, its objects, labels and reports into
places of its own, and the list of its completed images last of all: that list ends the round. What
a round that never ended has left is deleted by the next one, so that a crash at any place costs a
round and leaves no row twice.

The incremental form is a file stream of images: Spark's checkpoint remembers which were seen, and
each micro-batch reads and converts its own images only, so a restart takes up new images only.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import control, polygons, render, report
from tessera.plans import convert as C
from tessera.sources import files, sinks
from tessera.sources import images as I
from tessera.sources.decode import pixels

README = "Converted segmentation dataset: dataset/ holds images' labels and data.yaml, _debug_and_logs/ the reports.\n"
FAILURES = "image string, error_type string, error string, traceback string"


def name_table(spark: SparkSession, names: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(list(names.items()), "class_id int, name string")


def convert(
    spark: SparkSession, root: str, output: str, settings: C.Settings | None = None, overrides: dict[int, dict] | None = None,
    only: DataFrame | None = None, steering: control.Steering | None = None, round_images: int | None = None,
) -> dict:
    """Converts what isn't completed yet; returns the summary.

    only: a table of relative_image to restrict the run to; class statistics then cover earlier runs as well.
    steering pauses or stops the conversion between rounds of about round_images images (without it, one round).
    Jobs belong to the group "convert <output>".
    """
    settings, steering = settings or C.Settings(), steering or control.Steering()
    control.guard_output(root, output)
    control.guard_run(spark, output, settings.backend, settings.preset)
    with control.cancellable(spark, f"convert {output}"):
        run = control.begin(spark, output)
        state = f"{output}/{control.STATE}"
        data = I.scan(spark, root, only, f"{state}/scan/{run}")
        data.annotations.select("relative_image", "class_id", "bbox").write.mode("overwrite").parquet(f"{state}/annotations/{run}")
        known = C.class_profiles(seen(spark, output, run, "annotations", only), overrides)
        todo = data.images.join(control.completed(spark, output).select("relative_image"), "relative_image", "left_anti")
        n_todo = todo.count()
        n_rounds = max(1, -(-n_todo // round_images)) if round_images else 1
        steering.total = n_todo
        for k in range(n_rounds):
            if steering.stopped():
                break
            own = todo.where(F.pmod(F.xxhash64("relative_image"), F.lit(n_rounds)) == k)
            convert_round(spark, data, own, files.Folder(spark, root).uri, output, settings, known, run if k == 0 else f"{run}-{k}")
            steering.done = n_todo * (k + 1) // n_rounds
        if only is None:  # the scan covers the folder: those before it aren't needed any more
            for folder in ("scan", "annotations"):
                for old in control.children(spark, f"{state}/{folder}"):
                    if old.startswith("run-") and old != run:
                        control.delete(spark, f"{state}/{folder}/{old}")
        used = [r[0] for r in seen(spark, output, run, "annotations", only).select("class_id").distinct().collect()]
        sinks.write_data_yaml(spark, f"{output}/dataset", data.names, used)
        sinks.write_text(spark, f"{output}/README.txt", README, keep=True)
        return summarised(spark, output, settings, seen(spark, output, run, "scan", only).where("width is not null"), seen(spark, output, run, "annotations", only))


def seen(spark: SparkSession, output: str, run: str, table: str, only: DataFrame | None) -> DataFrame:
    """A table of this run, and of a restricted run that of those before it, too."""
    runs = [run] if only is None else [r for r in control.children(spark, f"{output}/{control.STATE}/{table}") if r.startswith("run-")]
    rows = spark.read.parquet(*(files.literal(f"{output}/{control.STATE}/{table}/{r}") for r in runs))
    return rows if only is None else rows.dropDuplicates([c for c in rows.columns if c != "content"])


def convert_round(spark: SparkSession, data: I.Dataset, todo: DataFrame, uri: str, output: str, settings: C.Settings, known: dict[int, dict], run: str) -> None:
    """Converts some images; all that is written but labels and pictures, which are overwritten when done again, is in folders of the run."""
    logs = f"{output}/_debug_and_logs"
    at = f"{output}/{control.STATE}/objects/{run}"
    malformed = data.issues.where("relative_image is not null").join(todo.select("relative_image"), "relative_image", "left_semi")
    good_images = todo.join(malformed.select("relative_image"), "relative_image", "left_anti")
    annotations = data.annotations.join(good_images.select("relative_image"), "relative_image", "left_semi")
    # model inference is worth a table: labels, reports and state are made from it
    C.refine(good_images, annotations, uri, known, settings, todo.count()).write.mode("overwrite").parquet(at)
    objects = spark.read.schema(C.OUT_DDL).parquet(files.literal(at))
    good = C.triaged(objects, known, settings)
    rows = C.report_rows(good, name_table(spark, data.names))
    failed = objects.where("error is not null").select(F.col("relative_image").alias("image"), "error_type", "error", "traceback")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "issue"))), lambda r: r["issue"]), "; ")
    bad = malformed.groupBy(F.col("relative_image").alias("image")).agg(F.lit("RuntimeError").alias("error_type"), text.alias("error"), F.lit("").alias("traceback"))
    lost = annotations.select("relative_image").distinct().join(objects.select("relative_image"), "relative_image", "left_anti")
    lost = lost.select(
        F.col("relative_image").alias("image"), F.lit("RuntimeError").alias("error_type"),
        F.lit("the conversion gave no result").alias("error"), F.lit("").alias("traceback"),
    )
    failures = failed.unionByName(bad).unionByName(lost)
    clean = todo.join(failures.select(F.col("image").alias("relative_image")), "relative_image", "left_anti").withColumn("label", C.label_path(F.col("relative_image")))
    lines = polygons.label_rows(good.withColumn("label", C.label_path(F.col("relative_image"))), ["label", "instance_index"])
    sinks.write_files(sinks.label_files(clean, lines), f"{output}/dataset")
    sinks.write_csv(rows, f"{logs}/reports/objects.csv", run)
    sinks.write_csv(rows.where("state = 'review'"), f"{logs}/reports/review_queue.csv", run)
    sinks.write_csv(failures, f"{logs}/reports/failures.csv", run)
    if settings.save_overlays:
        sinks.write_files(pictures(good, uri, overlaid), f"{logs}/overlays")
    if settings.save_previews:
        unsure = good.where("state = 'review'").select("relative_image").distinct()
        sinks.write_files(pictures(good.join(unsure, "relative_image", "left_semi"), uri, overlaid), f"{logs}/review_previews")
    if settings.save_comparisons:
        boxes = annotations.select("relative_image", "instance_index", "bbox")
        sinks.write_files(pictures(good.join(boxes, ["relative_image", "instance_index"], "left"), uri, compared), f"{logs}/comparisons")
    if settings.save_masks:
        sinks.write_files(instance_masks(good), f"{logs}/masks")
    if settings.copy_images:
        sinks.write_files(contents(clean, uri), f"{output}/dataset")
    per = good.groupBy("relative_image").agg(
        F.count("*").alias("objects"), F.round(F.avg("quality"), 4).alias("mean_quality"),
        F.count_if(F.col("state") == "review").alias("review"),
    )
    control.mark_completed(clean.select("relative_image").join(per, "relative_image", "left").na.fill(0, ["objects", "review"]), output, run)


def summarised(spark: SparkSession, output: str, settings: C.Settings, images: DataFrame, annotations: DataFrame) -> dict:
    """Writes and returns the summary of all runs; an image that failed once and was completed later is no failure."""
    logs = f"{output}/_debug_and_logs"
    columns = (c.split() for c in C.S.OBJECTS.split(", "))
    text = ", ".join(f"{name} {'string' if kind.startswith('array') else kind}" for name, kind in columns)
    rows = sinks.read_csv(spark, f"{logs}/reports/objects.csv", text)
    failures = sinks.read_csv(spark, f"{logs}/reports/failures.csv", FAILURES).dropDuplicates(["image"])
    failures = failures.join(control.completed(spark, output).select(F.col("relative_image").alias("image")), "image", "left_anti")
    summary = report.run_summary(images, rows, failures, settings.min_fidelity)
    extra = {"backend": settings.backend, "preset": settings.preset, "objects": annotations.count()}
    return sinks.write_summary(summary, report.prompts_seen(rows), f"{logs}/reports/summary.json", extra)


def points(ring: list) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring])


def overlaid(image: np.ndarray, objects: list[dict]) -> np.ndarray:
    """The image with all rings drawn in."""
    return render.overlay(image, [], [([points(ring) for ring in o["rings"]], o["state"]) for o in objects])


def compared(image: np.ndarray, objects: list[dict]) -> np.ndarray:
    """What came in (boxes) beside what came out (rings)."""
    boxes = [tuple(o["bbox"][k] for k in ("x0", "y0", "x1", "y1")) for o in objects if o["bbox"]]
    return render.comparison(render.overlay(image, boxes, []), overlaid(image, objects))


def pictures(objects: DataFrame, uri: str, draw) -> DataFrame:
    """(path, content): a PNG of each image with objects; pixels are read by path."""
    has_box = "bbox" in objects.columns
    per = objects.groupBy("relative_image").agg(F.collect_list(F.struct("rings", "state", *(["bbox"] if has_box else []))).alias("objects"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                picture = draw(pixels(files.read(f"{uri}/{r['relative_image']}")), r["objects"])
                yield pa.RecordBatch.from_pydict({"path": [r["relative_image"].rsplit(".", 1)[0] + ".png"], "content": pa.array([render.png(picture)], pa.binary())})

    return spread(per).mapInArrow(run, "path string, content binary")


def contents(images: DataFrame, uri: str) -> DataFrame:
    """(path, content): the image files as they are."""

    def run(batches):
        for b in batches:
            for path in b.column("relative_image").to_pylist():
                yield pa.RecordBatch.from_pydict({"path": [path], "content": pa.array([files.read(f"{uri}/{path}")], pa.binary())})

    return spread(images.select("relative_image")).mapInArrow(run, "path string, content binary")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over as many tasks as a shuffle has: each stands for much more work than its bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "relative_image")


def instance_masks(objects: DataFrame) -> DataFrame:
    """(path, content): one black and white PNG per object, drawn from its export rings."""
    from tessera.functions import raster

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                m = raster.from_parts([(points(ring), []) for ring in r["rings"]], r["width"], r["height"])
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": [f"{r['relative_image'].rsplit('.', 1)[0]}/instance_{r['instance_index']:03d}.png"],
                        "content": pa.array([render.png(m.astype(np.uint8) * 255)], pa.binary()),
                    }
                )

    return spread(objects.select("relative_image", "width", "height", "instance_index", "rings")).mapInArrow(run, "path string, content binary")


def convert_batch(rows: DataFrame, _: int, root: str, output: str, settings: C.Settings | None) -> None:
    spark = rows.sparkSession
    names = files.Folder(spark, root).relative(rows.select("path")).select(F.col("path").alias("relative_image"))
    if not names.isEmpty():
        convert(spark, root, output, settings, only=names)


def convert_stream(spark: SparkSession, root: str, output: str, checkpoint: str, settings: C.Settings | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Follows a folder: each micro-batch of new images is converted and committed."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.{" + ",".join(C.S.SUFFIXES) + "}",
    ).load(files.literal(root))
    batch = functools.partial(convert_batch, root=root, output=output, settings=settings)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
