"""Reports over converted objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S


def object_report(objects: DataFrame, names: DataFrame) -> DataFrame:
    """Report rows: objects with their class names, numbers rounded as the report writes them."""
    named = objects.join(names, "class_id", "left").withColumn("class_name", F.coalesce("name", F.concat(F.lit("class_"), F.col("class_id").cast("string"))))
    four = [F.round(c, 4).alias(c) for c in ("sam_score", "stability", "edge_alignment", "leakage", "fragmentation", "fidelity", "quality")]
    return named.select(
        F.col("relative_image").alias("image"), F.col("instance_index").alias("instance"), "class_id", "class_name",
        F.lit("detection").alias("source_kind"), "prompt", *four, "parts", "holes", "points", "state",
        F.array_join("warnings", " | ").alias("warnings"),
        F.regexp_replace(F.regexp_replace("relative_image", "^images/", "labels/"), r"\.[^/.]+$", ".txt").alias("output_label"),
    )


def run_summary(images: DataFrame, report: DataFrame, failures: DataFrame, min_fidelity: float = S.MIN_FIDELITY) -> DataFrame:
    """One row: counts by state, and quality and fidelity as the report rounds them."""
    rows = report.agg(
        F.count("*").alias("processed_object_rows"), F.count_if(F.col("state") == "accepted").alias("accepted"), F.count_if(F.col("state") == "review").alias("review"),
        F.round(F.avg("quality"), 4).alias("mean_quality"), F.round(F.avg("fidelity"), 4).alias("mean_polygon_fidelity"), F.min("fidelity").alias("min_polygon_fidelity"),
        F.count_if(F.col("fidelity") < min_fidelity).alias("below_fidelity_threshold"), F.coalesce(
            F.bool_or(F.col("prompt").startswith("fallback")), F.lit(False),
        ).alias("placeholder"),
    )
    return rows.crossJoin(images.agg(F.count("*").alias("images"))).crossJoin(failures.agg(F.count("*").alias("failed_images")))  # one row each


def prompts_seen(report: DataFrame) -> DataFrame:
    name = F.substring_index("prompt", " / ", 1)
    return report.where("prompt is not null and prompt <> ''").groupBy(name.alias("prompt")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prompt")


def review_filters(report: DataFrame) -> DataFrame:
    """How many rows of the review queue each filter shows."""
    low = F.lower(F.col("warnings"))
    counts = report.agg(F.count("*").alias("all"), *(F.count_if(low.contains(text)).alias(k) for k, text in S.FILTERS.items()))
    keys = ["all", *S.FILTERS]
    return counts.selectExpr(f"stack({len(keys)}, " + ", ".join(f"'{k}', `{k}`" for k in keys) + ") as (filter, n)")


def image_rollup(report: DataFrame) -> DataFrame:
    # in whole ten-thousandths, as the report has them: sums are exact in any order
    total, n = F.sum(F.round(F.col("quality") * 10000).cast("long")), F.count("*")
    return report.groupBy("image").agg(
        F.count("*").alias("objects"), (F.floor((2 * total + n) / (2 * n)) / 10000.0).alias("mean_quality"),
        F.count_if(F.col("state") == "review").alias("review"),
    )


def run_stats(report: DataFrame, width: int = 1000) -> DataFrame:
    """Running totals in image order.

    Totals of ranges of `width` ids, of ranges of width * width ids and so on come first, so no window holds
    more than `width` rows however large the ids are.
    """
    sums = ["images", "objects", "accepted"]
    top = report.agg(F.max(F.abs(F.col("image_id").cast("long")))).first()[0] or 0  # one number tells how many levels there are
    n_levels = 1
    while top >= width ** (n_levels + 1):
        n_levels += 1
    accepted = F.count_if(F.col("state") == "accepted").alias("accepted")
    per = report.groupBy("image_id").agg(F.lit(1).cast("long").alias("images"), F.count("*").alias("objects"), accepted)
    levels = [per.withColumn("k1", F.floor(F.col("image_id") / width))]
    for n in range(1, n_levels + 1):
        ranges = levels[-1].groupBy(f"k{n}").agg(*(F.sum(c).alias(c) for c in sums))
        levels.append(ranges.withColumn(f"k{n + 1}", F.floor(F.col(f"k{n}") / width)))
    before = None  # totals of all before each range, from the coarsest ranges on
    for n in range(n_levels, 0, -1):
        own, up = levels[n], f"k{n + 1}"
        earlier = Window.partitionBy(up).orderBy(f"k{n}").rowsBetween(Window.unboundedPreceding, -1)
        rows = own.select(f"k{n}", up, *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums))
        if before is None:  # of the coarsest ranges, the few above are in order too
            above = own.groupBy(up).agg(*(F.sum(c).alias(c) for c in sums))
            whole = Window.orderBy(up).rowsBetween(Window.unboundedPreceding, -1)  # two rows at most: of negative ids, and others
            before = above.select(up, *(F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"a_{c}") for c in sums))
        before = rows.join(before, up).select(f"k{n}", *((F.col(c) + F.col(f"a_{c}")).alias(f"a_{c}") for c in sums))
    inside = Window.partitionBy("k1").orderBy("image_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = levels[0].select("image_id", "k1", *(F.sum(c).over(inside).alias(c) for c in sums)).join(before, "k1")
    return rows.select("image_id", *((F.col(c) + F.col(f"a_{c}")).alias(c) for c in sums))


def duration(seconds: Column) -> Column:
    """5s, 1m 15s or 1h 02m; negative times count as 0."""
    s = F.greatest(F.lit(0).cast("long"), seconds.cast("long"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    whole = lambda x, n: F.floor(x / n).cast("string")
    return F.when(
        s >= 3600, F.concat(whole(s, 3600), F.lit("h "), two(F.floor((s % 3600) / 60)), F.lit("m")),
    ).when(s >= 60, F.concat(whole(s, 60), F.lit("m "), two(s % 60), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def throughput(current: Column, total: Column, elapsed: Column) -> dict[str, Column]:
    """Seconds per image (the first image isn't counted) and the time that is left."""
    done = current - 1
    per = F.when((done > 0) & (elapsed > 0), elapsed / done)
    return {"per_image": per, "remaining": F.greatest(F.lit(0), total - current) * per}


def backend_summary(runs: DataFrame) -> DataFrame:
    ok = F.col("error").isNull()
    return runs.groupBy("backend").agg(
        F.round(F.avg(F.when(ok, F.col("quality"))), 6).alias("quality"), F.round(
            F.avg(F.when(ok, F.col("fidelity"))), 6,
        ).alias("fidelity"), F.round(F.avg(F.when(ok, F.col("parts"))), 6).alias("parts"),
        F.round(
            F.avg(F.when(ok, F.col("points"))), 6,
        ).alias("points"), F.count_if(~ok).alias("failed"), F.round(F.sum("seconds") / F.count("*"), 6).alias("seconds_per_object"),
    )


def agreement(ious: DataFrame) -> DataFrame:
    """Per pair of backends: mean and median IoU, and how many objects are below one half."""
    return ious.groupBy("backend_a", "backend_b").agg(
        F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.median("iou"), 6).alias("median_iou"),
        F.count_if(F.col("iou") < 0.5).alias("below_half"),
    )


def pending(images: DataFrame, done: DataFrame, label_files: DataFrame, key: str = "image_id") -> DataFrame:
    """What a resumed run still has to do: images that aren't both completed and labelled."""
    complete = done.join(label_files.select(key), key, "left_semi")
    return images.join(complete.select(key), key, "left_anti")
