"""Sinks of a conversion: label files, reports, summary, data.yaml, pictures and run state.

Files per image go through a Python data source with Spark's commit protocol: a task writes beside
the target, and the file is moved into place whole, so a retried task can't leave half a label.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessera.sources.files import literal


class FilesWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from tessera.sources.files import place

        system, base = place(self.root)
        for path, content in rows:
            target = f"{base}/{path}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(f"{target}.tmp") as f:
                f.write(bytes(content))
            system.move(f"{target}.tmp", target)
        return WriterCommitMessage()


class Files(DataSource):
    """Rows (path, content) as files below a folder."""

    @classmethod
    def name(cls) -> str:
        return "tessera_files"

    def writer(self, schema, overwrite):
        return FilesWriter(self.options["path"])


def uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write_files(rows: DataFrame, root: str) -> None:
    """rows: path string, content binary."""
    rows.sparkSession.dataSource.register(Files)
    rows.select("path", F.col("content").cast("binary").alias("content")).write.format("tessera_files").mode("append").save(uri(root))


def label_files(images: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, content): each image's label file; images without lines get an empty one. images: label; lines: label, instance_index, part, line."""
    text = lines.groupBy("label").agg(
        F.concat(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("instance_index", "part", "line"))), lambda r: r["line"]), "\n"),
            F.lit("\n"),
        ).alias("t")
    )
    return images.select("label").join(text, "label", "left").select(F.col("label").alias("path"), F.coalesce("t", F.lit("")).cast("binary").alias("content"))


def write_csv(rows: DataFrame, path: str, part: str = "") -> None:
    """A report as CSV with a header; an existing report must have the same columns. part: a folder in it that is written anew."""
    spark = rows.sparkSession
    check_header(spark, path, rows.columns)
    at = f"{path}/{part}" if part else path
    rows.write.mode("overwrite" if part else "append").option("header", True).option("escape", '"').option("quoteAll", True).csv(at)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True).schema(schema).csv(literal(path))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(p)] if system.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def check_header(spark: SparkSession, path: str, columns: list[str]) -> None:
    if children(spark, path):
        found = spark.read.option("header", True).option("recursiveFileLookup", True).csv(literal(path)).columns
        if found and found != columns:
            raise RuntimeError(f"{path} has other columns: {found}")


def write_text(spark: SparkSession, path: str, text: str, keep: bool = False) -> None:
    """One small file from the driver; keep: leave an existing one alone."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if keep and system.exists(p):
        return
    stream = system.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    rows = spark.read.text(literal(path), wholetext=True).collect()
    return rows[0][0] if rows else ""


def write_data_yaml(spark: SparkSession, root: str, names: dict[int, str], used: list[int], splits: dict[str, str] | None = None) -> None:
    """data.yaml of a segmentation dataset: contiguous names from 0, gaps as class_<id>."""
    import yaml

    top = max([i for i in (*names, *used) if i >= 0], default=-1)
    all_names = {i: names.get(i, f"class_{i}") for i in range(top + 1)}
    body = {"path": ".", "task": "segment", **(splits or {"train": "images", "val": "images"}), "nc": len(all_names), "names": all_names}
    write_text(spark, f"{root}/data.yaml", yaml.safe_dump(body, sort_keys=False, allow_unicode=True))


def write_summary(summary: DataFrame, prompts: DataFrame, path: str, extra: dict) -> dict:
    """summary.json: one row of aggregates, the prompts seen, and a warning if placeholders are among them."""
    row = summary.first().asDict() | extra | {"prompts_seen": {r.prompt: r.n for r in prompts.collect()}}
    if row.pop("placeholder", False):
        row["warning"] = "This dataset contains placeholder masks of the 'fallback' backend; they are no real segmentation and must be converted again."
    write_text(summary.sparkSession, path, json.dumps(row, indent=2, default=str))
    return row
