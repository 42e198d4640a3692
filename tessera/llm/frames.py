"""How the operators of this subpackage meet Spark: reading tables, mapping text in Arrow batches, shared scratch tables."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.kernels import slices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(names: list[str], columns: list, types: list[pa.DataType]) -> pa.RecordBatch:
    """A record batch from numpy arrays, lists or Arrow arrays."""
    arrays = []
    for c, kind in zip(columns, types, strict=True):
        if isinstance(c, pa.ChunkedArray):
            c = c.combine_chunks()
        arrays.append(c.cast(kind) if isinstance(c, pa.Array) else pa.array(c, kind))
    return pa.RecordBatch.from_arrays(arrays, names=names)


#: Spark's default for the bytes of an Arrow batch, and ours: a batch is cut into slices anyway.
USUAL_BATCH, OUR_BATCH = "67108864b", "2m"


def bounded(spark: SparkSession) -> None:
    """Lets Arrow batches be a few MB, so that long texts don't fill a worker; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) == USUAL_BATCH:
        spark.conf.set(key, OUR_BATCH)


def map_text(
    docs: DataFrame, id_col: str, text_col: str, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """Apply `kernel` to slices of (doc_id, text, *also), in the scan's own partitions: no shuffle.

    Only the named columns are read, so other columns, whatever their names, neither cost nor clash.
    """

    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = kernel(part)
                if out is not None:
                    yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *also).mapInArrow(run, schema)


def numbered(docs: DataFrame) -> DataFrame:
    """The same columns as c0, c1 ...: whatever names a table has, they neither clash with ours nor read as paths."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def number_of(docs: DataFrame, column: str) -> str:
    """The name of a column in numbered(docs)."""
    return f"c{docs.columns.index(column)}"


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tessera-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of its own; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_dir()


#: Lists of the tables that were written inside of tidy(), innermost last.
_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Deletes, at its end, the scratch tables that were written inside, but for those that it was given to keep (like written())."""
    _SCOPES.append([])

    def keep(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
        out = written(df, scratch)
        _SCOPES[-1].pop()
        return out

    try:
        yield keep
    finally:
        discard(spark, _SCOPES.pop())


def written(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no recomputation.

    The path is added to `scratch`, for discard() once nothing reads the table any more. Tables that a result
    reads stay until tidy() ends, or as long as the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes written tables."""
    while scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts_for(spark: SparkSession, n_bytes: int, each: int, least: int = 1) -> int:
    """How many parts of about `each` bytes an exchange of n_bytes should have."""
    return max(least, -(-int(n_bytes or 0) // each))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of text in all documents: one pass of a column, one number to the driver."""
    return docs.select(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0


#: Bytes of text whose results go into one file.
FILE_BYTES = 64 << 20


def gathered(rows: DataFrame, n_bytes: int) -> DataFrame:
    """A few numbers of each document of a corpus of n_bytes, in few partitions: a shuffle's many would be as many small files."""
    return rows.repartition(parts_for(rows.sparkSession, n_bytes, FILE_BYTES))


#: Rows that a join may broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose `column` isn't among keys (a written table of that one column); keys are broadcast only if they are few enough."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, column, "left_anti")
