"""Image datasets as DataFrames: enumeration, header sizes without decoding, labels, issues.

A folder is listed by Spark; what has to be read of a file is read where its row is, by path.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import labels as L
from tessera.operators.dataset import lines_of
from tessera.sources import files
from tessera.sources.files import Folder


def image_listing(listed: DataFrame, path: str = "path") -> DataFrame:
    """Files with an image suffix: those below an images/ folder outside of output folders, if there are any, else all; distinct, by path."""
    pics = listed.where(F.lower(F.col(path)).rlike(r"\.(" + "|".join(S.SUFFIXES) + ")$"))
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    depth = F.array_position(folders, "images")
    above = F.slice(folders, 1, F.greatest(depth.cast("int") - 1, F.lit(0)))
    inside = (depth > 0) & ~F.arrays_overlap(above, F.array(*map(F.lit, S.NOT_SOURCES)))
    marked = pics.withColumn("_in", inside)
    any_inside = marked.agg(F.coalesce(F.bool_or("_in"), F.lit(False)).alias("_any"))
    rows = marked.crossJoin(F.broadcast(any_inside)).where(F.col("_in") | ~F.col("_any"))  # one row
    return rows.drop("_in", "_any").dropDuplicates([path]).orderBy(path)


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from a file's header; None if it can't be read."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(data):
                if data[at] != 0xFF:
                    return None
                kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + size if not 0xD0 <= kind <= 0xD9 else 2
            return None
        if data[:4] in (b"II*\0", b"MM\0*"):
            o = "<" if data[:2] == b"II" else ">"
            at, found = struct.unpack(o + "I", data[4:8])[0], {}
            for k in range(struct.unpack(o + "H", data[at : at + 2])[0]):
                tag, kind = struct.unpack(o + "HH", data[at + 2 + 12 * k : at + 6 + 12 * k])
                value = data[at + 10 + 12 * k : at + 14 + 12 * k]
                found[tag] = struct.unpack(o + "H", value[:2])[0] if kind == 3 else struct.unpack(o + "I", value)[0]
            return (found[256], found[257]) if 256 in found and 257 in found else None
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8 ":
                w, h = struct.unpack("<HH", data[26:30])
                return w & 0x3FFF, h & 0x3FFF
            if kind == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            if kind == b"VP8X":
                return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    except (struct.error, IndexError):
        pass
    return None


#: Bytes of a file that are read for its size; if they don't hold it, the whole file is.
HEADER = 1 << 16
#: Images in a task that reads headers and labels.
IMAGES_PER_TASK = 500


def described(images: DataFrame, folder: Folder) -> DataFrame:
    """path, width, height, label (the first candidate that exists, else the first) and content (null without a label).

    images: path, candidates. Headers and labels are read by path, so no image is read whole and nothing is joined.
    """
    uri, top = folder.uri, folder.top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, candidates in zip(b.column("path").to_pylist(), b.column("candidates").to_pylist(), strict=True):
                try:
                    size = image_size(files.read(f"{uri}/{path}", HEADER)) or image_size(files.read(f"{uri}/{path}"))
                except OSError:
                    size = None
                inside = [c for c in candidates if c.startswith(top + "/")]
                label = next((c for c in inside if files.is_file(uri + c[len(top) :])), None)
                content = None if label is None else files.read(uri + label[len(top) :])
                out.append((path, *(size or (None, None)), label or candidates[0], content))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, DESCRIBED.types, strict=True)],
                names=DESCRIBED.names,
            )

    return images.select("path", "candidates").mapInArrow(run, "path string, width int, height int, label string, content binary")


DESCRIBED = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("label", pa.string()), ("content", pa.binary())])


class Dataset:
    """A scanned folder: images, annotations and issues as DataFrames, and the class names."""

    def __init__(self, images: DataFrame, annotations: DataFrame, issues: DataFrame, names: dict[int, str]):
        self.images, self.annotations, self.issues, self.names = images, annotations, issues, names


def scan(spark: SparkSession, root: str, only: DataFrame | None = None, keep: str | None = None) -> Dataset:
    """Scans a folder that Spark can read. A missing folder is an error, as is the output of a conversion; an unreadable image is an issue of the dataset.

    only: a table of relative_image to restrict the scan to. keep: where to write what is read of images and labels,
    as a Parquet table; without it every use of the result reads the folder again.
    """
    from pyspark.sql import Window

    from tessera.operators.control import generated_marker
    from tessera.sources.names import class_names

    folder = Folder(spark, root)
    if marker := generated_marker(spark, folder.uri):
        raise ValueError(f"{root} lies in {marker}, the output of a conversion")
    top = folder.top
    pics = image_listing(folder.listing())
    if only is not None:
        pics = pics.join(only.select(F.col("relative_image").alias("path")), "path", "left_semi")
    pics = pics.withColumn("candidates", L.label_candidates(F.concat(F.lit(top + "/"), F.col("path")), F.lit(top)))
    n_tasks = max(spark.sparkContext.defaultParallelism, -(-pics.count() // IMAGES_PER_TASK))
    found = described(pics.repartition(n_tasks, "path"), folder)
    if keep:
        found.write.mode("overwrite").parquet(keep)
        found = spark.read.schema(found.schema).parquet(files.literal(keep))
    broken = found.where("width is null")
    images = found.where("width is not null").select(
        F.col("path").alias("relative_image"), "width", "height", F.concat(F.lit(top + "/"), "path").alias("image_path"),
        F.col("label").alias("label_path"), F.col("content").isNotNull().alias("labelled"), "content",
    )
    readable = F.expr("is_valid_utf8(content)")
    lines = images.where(F.col("labelled") & readable).select(
        "relative_image", "width", "height", F.posexplode(lines_of(F.col("content").cast("string"))).alias("line_no", "line"),
    ).withColumn("line_no", F.col("line_no") + 1)
    rows = L.parsed(lines)
    order = Window.partitionBy("relative_image").orderBy("line_no")
    index = (F.row_number().over(order) - 1).cast("int")
    columns = ["relative_image", "width", "height", "instance_index", "class_id", "kind", "bbox", "polygon"]
    annotations = rows.where("valid").withColumn("instance_index", index).select(*columns, F.trim("line").alias("source_line"))
    name = F.regexp_extract("path", "[^/]+$", 0)
    issues = (
        broken.select(
            F.lit(None).cast("string").alias("relative_image"), F.lit(0).alias("line_no"),
            F.concat(F.lit("Cannot open "), name, F.lit(": unreadable header")).alias("issue"),
        )
        .unionByName(
            rows.where("issue is not null").select(
                "relative_image", "line_no",
                F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(": "), "issue").alias("issue"),
            )
        )
        .unionByName(
            images.where(F.col("labelled") & ~readable).select(
                "relative_image", F.lit(0).alias("line_no"), F.lit("Cannot read label file: not UTF-8").alias("issue"),
            )
        )
    )
    if found.isEmpty():
        issues = spark.createDataFrame([(None, 0, "No supported images were found.")], "relative_image string, line_no int, issue string")
    return Dataset(images.drop("content"), annotations, issues, class_names(spark, root))
