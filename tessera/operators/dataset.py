"""Dataset-level aggregates over images, annotations and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import labels as L


def annotations_of(lines: DataFrame, key: str = "image_id") -> DataFrame:
    """Valid rows of parsed label lines, numbered per image among valid rows."""
    order = Window.partitionBy(key).orderBy("line_no")
    return L.parsed(lines).where("valid").withColumn("instance_index", (F.row_number().over(order) - 1).cast("int"))


def issues_of(lines: DataFrame) -> DataFrame:
    """One issue per malformed row, with its physical line number."""
    bad = L.parsed(lines).where(F.col("issue").isNotNull())
    return bad.withColumn("issue", F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(": "), F.col("issue")))


def lines_of(text: Column) -> Column:
    """Physical lines of a file, as str.splitlines gives them."""
    parts = F.split(text, L.LINE_END)
    return F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def background_images(images: DataFrame, annotations: DataFrame, issues: DataFrame, key: str = "image_id") -> DataFrame:
    """Images with neither annotations nor issues."""
    return images.join(annotations.select(key), key, "left_anti").join(issues.select(key), key, "left_anti")


def problem_images(images: DataFrame, issues: DataFrame, key: str = "image_id") -> DataFrame:
    return images.join(issues.select(key), key, "left_semi")


def convertible_images(images: DataFrame, issues: DataFrame, key: str = "image_id") -> DataFrame:
    return images.join(issues.select(key), key, "left_anti")


def summary(images: DataFrame, annotations: DataFrame, issues: DataFrame, key: str = "image_id") -> DataFrame:
    """Counts of images, objects (those of problem images too), boxes, polygons, backgrounds, problems and labelled images."""
    per = annotations.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "detection").alias("boxes"))
    bad = issues.groupBy(key).agg(F.count("*").alias("bad"))
    rows = images.select(key).join(per, key, "left").join(bad, key, "left").na.fill(0)
    return rows.agg(
        F.count("*").alias("images"), F.sum("n").alias("objects"), F.sum("boxes").alias("boxes"), F.sum(F.col("n") - F.col("boxes")).alias("polygons"),
        F.count_if(
            (F.col("n") == 0) & (F.col("bad") == 0)
        ).alias("backgrounds"), F.count_if(F.col("bad") > 0).alias("problems"), F.count_if(F.col("n") + F.col("bad") > 0).alias("labelled"),
    )


def class_histogram(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("class_id").agg(F.count("*").alias("n")).orderBy("class_id")


def image_breakdown(annotations: DataFrame, names: DataFrame | None = None, key: str = "image_id") -> DataFrame:
    """Per image: `class xN` for each class, by name; classes without a name (class_id, name) are class_<id>."""
    per = annotations.groupBy(key, "class_id").agg(F.count("*").alias("n"))
    name = F.concat(F.lit("class_"), F.col("class_id").cast("string"))
    if names is not None:
        per, name = per.join(F.broadcast(names), "class_id", "left"), F.coalesce("name", name)  # one row for each class
    text = F.concat(name, F.lit(" ×"), F.col("n").cast("string"))
    return per.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(text)), ", ").alias("breakdown"))


def layout(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How labels lie beside their images: from image_path and label_path (null: none) of all images, of each dataset if columns name it."""
    same = F.count_if(L.parent(F.col("label_path")) == L.parent(F.col("image_path")))
    apart = F.count_if(L.parent(F.col("label_path")) != L.parent(F.col("image_path")))
    words = (
        F.when(F.col("n") == 0, "unknown")
        .when((F.col("same") > 0) & (F.col("apart") == 0), "images and labels in the same folder")
        .when((F.col("apart") > 0) & (F.col("same") == 0), "separate images/ and labels/ folders")
        .when((F.col("apart") > 0) | (F.col("same") > 0), "mixed (some labels beside images, some in labels/)")
        .otherwise("no label files found")
    )
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), same.alias("same"), apart.alias("apart")).select(*by, words.alias("layout"))


def issue_table(dataset_issues: DataFrame, issues: DataFrame) -> DataFrame:
    """Dataset-level issues first, then those of images."""
    return dataset_issues.select(F.lit(0).alias("rank"), F.lit("Dataset").alias("image"), F.lit(0).alias("line_no"), "issue").unionByName(
        issues.select(F.lit(1).alias("rank"), F.col("relative_image").alias("image"), "line_no", "issue")
    )


def status(counts: DataFrame, convertible_with_objects: DataFrame) -> DataFrame:
    """Whether a dataset can be converted, and in which words that is said."""
    ready = convertible_with_objects.agg(F.count("*").alias("ready_images"))
    return counts.crossJoin(ready).select(  # one row each
        "ready_images", "objects", "backgrounds", "problems",
        F.when(F.col("ready_images") > 0, "ready").when(F.col("objects") == 0, "no objects").otherwise("all images have problems").alias("status"),
    )


def contiguous_names(annotations: DataFrame, names: DataFrame) -> DataFrame:
    """Names for every id from 0 to the largest that is used or named; gaps are class_<id>. Negative ids get none."""
    ids = annotations.select("class_id").unionByName(names.select("class_id")).where("class_id >= 0").agg(F.max("class_id").alias("top")).where("top is not null")
    return ids.select(F.explode(F.sequence(F.lit(0), "top")).alias("class_id")).join(names, "class_id", "left").select(
        "class_id", F.coalesce("name", F.concat(F.lit("class_"), F.col("class_id").cast("string"))).alias("name"),
    )


def neighbours(images: DataFrame, annotations: DataFrame, current: DataFrame, key: str = "image_id") -> DataFrame:
    """For each current image (a small table of `current`): the next and the previous annotated image, around the ends.

    Keys are compared in one pass, so no window over all images is needed to page through them.
    """
    annotated = images.select(key).join(annotations.select(key), key, "left_semi")
    k, c = F.col(key), F.col("current")
    found = annotated.crossJoin(F.broadcast(current)).groupBy("current").agg(  # a page's few rows
        F.min(F.when(k > c, k)).alias("after"), F.min(k).alias("first"), F.max(F.when(k < c, k)).alias("before"), F.max(k).alias("last")
    )
    return found.select("current", F.coalesce("after", "first").alias("next"), F.coalesce("before", "last").alias("previous"))
