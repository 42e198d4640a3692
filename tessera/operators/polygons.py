"""Masks to polygons to label rows. Raster kernels run in Arrow batches; counts and text are Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import raster as R

RING = "array<struct<x:double,y:double>>"
PARTS = f"array<struct<exterior:{RING},holes:array<{RING}>>>"


def as_points(ring) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def as_parts(parts) -> list[dict]:
    return [{"exterior": as_points(e), "holes": [as_points(h) for h in holes]} for e, holes in parts]


def as_ring(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


def mask_of(m: dict) -> np.ndarray:
    return R.unpack(m["words"], m["w"], m["h"])


def as_mask(mask: np.ndarray, x0: int = 0, y0: int = 0) -> dict:
    return {"x0": x0, "y0": y0, "w": mask.shape[1], "h": mask.shape[0], "words": R.pack(mask).tolist()}


def mapped(rows: DataFrame, added: str, f: Callable[[dict], dict], keep: list[str], reads: list[str], spread: bool = True) -> DataFrame:
    """Adds columns (DDL) that f makes of each row: Arrow batches in and out, only the needed columns shipped.

    A row's kernel costs far more than its bytes tell, so rows are dealt over all cores first.
    """
    columns = list(dict.fromkeys([*keep, *reads]))
    plain = rows.select(*columns)
    if spread:
        plain = plain.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in plain.schema if c.name in keep), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f(r) for r in batch.select(reads).to_pylist()]
            names = list(made[0]) if made else []
            if not made:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),
                    *(pa.array([m[n] for m in made]) if n not in NESTED else pa.array([m[n] for m in made], NESTED[n]) for n in names),
                ],
                names=[*keep, *names],
            )

    return plain.mapInArrow(run, schema)


_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_MASK = pa.struct([("x0", pa.int32()), ("y0", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("words", pa.list_(pa.int64()))])
#: Arrow types by column name, where a value alone doesn't tell.
NESTED = {
    "parts": pa.list_(pa.struct([("exterior", pa.list_(_POINT)), ("holes", pa.list_(pa.list_(_POINT)))])),
    "rings": pa.list_(pa.list_(_POINT)), "mask": _MASK, "areas": pa.list_(pa.int64()), "point": _POINT, "box": pa.list_(pa.int32()),
    "n": pa.int32(), "lost": pa.int32(), "vertices": pa.int32(), "area": pa.int64(), "fidelity": pa.float64(), "score": pa.float64(), "scores": pa.list_(
        pa.struct([("vec_id", pa.int64()), *((c, pa.float64()) for c in ("stability", "leakage", "fragmentation", "quality"))])
    ), "value": pa.float64(), "flags": pa.list_(pa.bool_()),
}


def component_areas(masks: DataFrame, keep: list[str]) -> DataFrame:
    return mapped(masks, "areas array<bigint>", lambda r: {"areas": R.components(mask_of(r["mask"]))[1].tolist()}, keep, ["mask"])


def mask_parts(masks: DataFrame, keep: list[str], least_area: float = 0, most: int = 0) -> DataFrame:
    return mapped(masks, f"parts {PARTS}", lambda r: {"parts": as_parts(R.to_parts(mask_of(r["mask"]), least_area, 1, most))}, keep, ["mask"])


def polygonised(masks: DataFrame, keep: list[str], target: str = "target", most: int = 0) -> DataFrame:
    """parts simplified under the fidelity bound, export rings, the fidelity of what is written, and holes lost."""

    def f(r: dict) -> dict:
        mask = mask_of(r["mask"])
        parts, _ = R.to_fidelity(mask, R.to_parts(mask, most=most), r[target])
        rings, got, lost = R.export_rings(mask, parts)
        move = np.array([r["mask"]["x0"], r["mask"]["y0"]], float)
        return {"parts": as_parts([(e + move, [h + move for h in hs]) for e, hs in parts]), "rings": [as_points(x + move) for x in rings], "fidelity": got, "lost": lost}

    return mapped(masks, f"parts {PARTS}, rings array<{RING}>, fidelity double, lost int", f, keep, ["mask", target])


def counts() -> list[Column]:
    """Parts, holes, and vertices of the export rings."""
    holes = F.aggregate("parts", F.lit(0), lambda s, p: s + F.size(p["holes"]))
    points = F.aggregate("rings", F.lit(0), lambda s, r: s + F.size(r))
    return [F.size("parts").alias("parts"), holes.alias("holes"), points.alias("points")]


def label_rows(objects: DataFrame, keep: list[str]) -> DataFrame:
    """One label row per ring of three points or more: class and coordinates as shares of the frame, six decimals."""
    ring = objects.select(*keep, "class_id", "width", "height", F.posexplode("rings").alias("part", "ring")).where(F.size("ring") >= 3)
    share = lambda v, n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / n))
    six = lambda v: F.concat(F.floor(F.bround(v * 1e6) / 1e6).cast("string"), F.lit("."), F.lpad((F.bround(v * 1e6) % 1e6).cast("long").cast("string"), 6, "0"))
    text = F.array_join(F.flatten(F.transform("ring", lambda p: F.array(six(share(p["x"], F.col("width"))), six(share(p["y"], F.col("height")))))), " ")
    return ring.select(*keep, "part", F.concat(F.col("class_id").cast("string"), F.lit(" "), text).alias("line"))
