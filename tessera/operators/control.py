"""Run control: provenance, resuming, output folders."""

from __future__ import annotations

import contextlib
import json
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.files import literal
from tessera.sources.sinks import children, delete, exists, read_text, write_text

STATE, ARTIFACTS = "state", ("_debug_and_logs", "qa", "")


def generated_marker(spark: SparkSession, path: str) -> str | None:
    """The output folder that a path lies in, if it is one of ours."""
    at = path.rstrip("/")
    while at and not at.endswith(":"):
        if exists(spark, f"{at}/{STATE}/run.json") or (
            exists(spark, f"{at}/reports/summary.json") and (exists(spark, f"{at}/overlays") or exists(spark, f"{at}/dataset"))
        ):
            return at
        at = at.rpartition("/")[0]
    return None


def guard_output(source: str, output: str) -> None:
    """Output inside of the source would be read as input the next time."""
    a, b = source.rstrip("/") + "/", output.rstrip("/") + "/"
    if b.startswith(a):
        raise ValueError(f"the output {output} lies in the source {source}")


def guard_run(spark: SparkSession, output: str, backend: str, preset: str) -> None:
    """Refuses to continue a run of another backend or preset, or progress without a signature."""
    text = read_text(spark, f"{output}/{STATE}/run.json")
    if text:
        run = json.loads(text)
        if (run["backend"], run["preset"]) != (backend, preset):
            raise RuntimeError(f"{output} holds results of {run['backend']}/{run['preset']}")
    elif exists(spark, f"{output}/{STATE}/completed") or exists(spark, f"{output}/labels"):
        raise RuntimeError(f"{output} holds results without a run signature")
    else:
        write_text(spark, f"{output}/{STATE}/run.json", json.dumps({"version": 1, "backend": backend, "preset": preset}))


#: Folders of an output that hold one folder for each run.
PER_RUN = (
    f"{STATE}/completed", f"{STATE}/scan", f"{STATE}/annotations", f"{STATE}/objects",
    *(f"_debug_and_logs/reports/{r}.csv" for r in ("objects", "review_queue", "failures")),
)


def ended_runs(spark: SparkSession, output: str) -> list[str]:
    at = f"{output}/{STATE}/completed"
    return [r for r in children(spark, at) if exists(spark, f"{at}/{r}/_SUCCESS")]


def begin(spark: SparkSession, output: str) -> str:
    """A new run's id. What runs that never ended have left is deleted first, so that no row is ever reported twice."""
    ended = set(ended_runs(spark, output))
    for folder in PER_RUN:
        for run in children(spark, f"{output}/{folder}"):
            if run.startswith("run-") and run not in ended:
                delete(spark, f"{output}/{folder}/{run}")
    return f"run-{uuid.uuid4().hex}"


COMPLETED = "relative_image string, objects long, mean_quality double, review long"


def completed(spark: SparkSession, output: str) -> DataFrame:
    paths = [literal(f"{output}/{STATE}/completed/{r}") for r in ended_runs(spark, output)]
    return spark.read.schema(COMPLETED).parquet(*paths) if paths else spark.createDataFrame([], COMPLETED)


def mark_completed(rows: DataFrame, output: str, run: str) -> None:
    """Ends a run: the last thing that it writes."""
    rows.select("relative_image", "objects", "mean_quality", "review").write.mode("overwrite").parquet(f"{output}/{STATE}/completed/{run}")


def free_output(spark: SparkSession, path: str) -> str:
    """The path itself, or the first of <path>_v2 ... _v999, or <path>_new, that doesn't exist."""
    for name in (path, *(f"{path}_v{i}" for i in range(2, 1000))):
        if not exists(spark, name):
            return name
    return f"{path}_new"


def artifact_dir(spark: SparkSession, output: str, name: str) -> str | None:
    """Where an artifact lies, in the present layout or an older one."""
    for folder in ARTIFACTS:
        at = "/".join(p for p in (output, folder, name) if p)
        if exists(spark, at):
            return at
    return None


class Steering:
    """Lets another thread pause or stop a conversion, and follow it."""

    def __init__(self):
        self._stop, self._go, self.done, self.total = threading.Event(), threading.Event(), 0, 0
        self._go.set()

    def stop(self) -> None:
        """No further round begins; one that runs ends, unless its jobs are cancelled too."""
        self._stop.set()
        self._go.set()

    def toggle_pause(self) -> bool:
        """Whether it is paused now."""
        if self._go.is_set():
            self._go.clear()
        else:
            self._go.set()
        return not self._go.is_set()

    def stopped(self) -> bool:
        """Waits while paused; whether to stop."""
        self._go.wait()
        return self._stop.is_set()


@contextlib.contextmanager
def cancellable(spark: SparkSession, group: str) -> Iterator[None]:
    """Jobs started inside can be stopped together from another thread: spark.sparkContext.cancelJobGroup(group)."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group, interruptOnCancel=True)
    try:
        yield
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
