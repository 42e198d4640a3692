"""Conversion: annotations of a dataset to scored, triaged polygons.

One row per image goes to the kernel, with its file and its annotations, so an image is decoded and
its edges are found once, and a failing object fails its image alone. Everything before and after is
relational. Images are independent: no task holds more than one of them.
"""

from __future__ import annotations

import traceback
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import labels as L
from tessera.functions import raster as R
from tessera.operators import backends, profiles, report, scoring
from tessera.operators.backends import Candidate
from tessera.operators.polygons import as_points
from tessera.sources import files
from tessera.sources.decode import grey, pixels


@dataclass(frozen=True)
class Settings:
    preset: str = "balanced"
    backend: str = "fallback"
    accept: float = S.ACCEPT
    review: float = S.REVIEW
    min_fidelity: float = S.MIN_FIDELITY
    save_masks: bool = False
    save_overlays: bool = False
    save_comparisons: bool = False
    save_previews: bool = False
    copy_images: bool = False


def consensus(candidates: list[Candidate]) -> Candidate | None:
    """The vote of the candidates around the best one, in single precision."""
    if len(candidates) < 2:
        return None
    best = max(range(len(candidates)), key=lambda i: (candidates[i].score, -i))
    cluster = [c for c in candidates if R.iou(candidates[best].mask, c.mask) >= S.CLUSTER_IOU]
    if len(cluster) < 2:
        return None
    w = np.array([max(0.05, c.score) for c in cluster], np.float32)
    vote = np.average(np.stack([c.mask for c in cluster]).astype(np.float32), axis=0, weights=w)
    return Candidate(vote >= 0.5, float(np.average([c.score for c in cluster], weights=w)), f"consensus({len(cluster)})")


def stability(mask: np.ndarray, raw: list[np.ndarray]) -> float:
    values = sorted((R.iou(mask, m) for m in raw), reverse=True)
    if values and values[0] > 0.999:
        values = values[1:]
    return float(np.mean(values[: min(len(values), max(2, len(values) // 3))])) if values else 1.0


def fragments(mask: np.ndarray, least: int) -> float:
    areas = R.components(mask)[1]
    areas = areas[areas >= max(2, least)]
    return 0.0 if len(areas) <= 1 else min(1.0, 1 - areas.max() / areas.sum() + 0.05 * (len(areas) - 1))


def leak(mask: np.ndarray, box: tuple, w: int, h: int) -> float:
    n = np.count_nonzero(mask)
    if not n:
        return 1.0
    x0, y0, x1, y1 = backends.perturbed(box, w, h, S.LEAK_GROWTH, 0, 0)
    x0, y0 = int(x0), int(y0)
    inside = np.count_nonzero(mask[y0 : max(y0 + 1, int(y1)), x0 : max(x0 + 1, int(x1))])
    return (n - inside) / n


def quality(score: float, v: dict, agreement: float, max_leakage: float) -> float:
    """The weighted sum of a candidate's metrics, less a penalty for leakage."""
    k = S.WEIGHTS
    q = k["sam"] * min(1.0, max(0.0, score)) + k["stability"] * v["stability"] + k["edge"] * v["edge_alignment"] + k["inside"] * (1 - min(1.0, v["leakage"])) + k["whole"] * (
        1 - min(1.0, v["fragmentation"])
    ) + k["agreement"] * agreement
    if v["leakage"] > max_leakage:
        q -= min(0.12, (v["leakage"] - max_leakage) * 0.5)
    return min(1.0, max(0.0, q))


def refined(annotation: dict, profile: dict, backend, preset: str, edges: np.ndarray) -> dict:
    """One object: candidates, vote, post-processing, metrics, the best candidate and its rings."""
    h, w = edges.shape
    b = annotation["bbox"]
    box = (b["x0"], b["y0"], b["x1"], b["y1"])
    source = np.array([(p["x"], p["y"]) for p in annotation["polygon"]]) if annotation["polygon"] else None
    found = backend.candidates(box, source, preset)
    if not found:
        raise RuntimeError("the backend gave no candidate")
    pad = max(64.0, box[2] - box[0], box[3] - box[1])
    x0, y0, x1, y1 = max(0, int(np.floor(box[0] - pad))), max(0, int(np.floor(box[1] - pad))), min(w, int(np.ceil(box[2] + pad))), min(h, int(np.ceil(box[3] + pad)))
    cut = lambda m: m[y0:y1, x0:x1]
    found = [Candidate(cut(c.mask), c.score, c.prompt) for c in found]
    if (vote := consensus(found)) is not None:
        found.append(vote)
    raw, own, near = [c.mask for c in found], tuple(np.subtract(box, (x0, y0, x0, y0))), cut(edges)
    agree = R.from_polygon(source - (x0, y0), x1 - x0, y1 - y0) if source is not None else None
    best = None
    for c in found:
        m = R.post_processed(c.mask, profile["close_kernel"], profile["open_kernel"], profile["min_component_area"], profile["preserve_thin"])
        v = {
            "stability": stability(m, raw), "edge_alignment": R.edge_alignment(m, near),
            "leakage": leak(m, own, x1 - x0, y1 - y0), "fragmentation": fragments(m, profile["min_component_area"]),
        }
        q = quality(c.score, v, 1.0 if agree is None else R.iou(m, agree), profile["max_leakage"])
        if best is None or q > best[0]:
            best = (q, m, c, v)
    q, m, c, v = best
    parts, _ = R.to_fidelity(m, R.to_parts(m, most=profile["max_parts"]), profile["target_fidelity"])
    rings, fidelity, lost = R.export_rings(m, parts)
    if not rings:
        raise RuntimeError("no polygon could be made of the mask")
    return v | {
        "prompt": c.prompt, "sam_score": c.score, "quality": q, "fidelity": fidelity, "parts": len(parts),
        "holes": sum(len(p[1]) for p in parts), "points": sum(map(len, rings)), "lost": lost,
        "rings": [as_points(r + (x0, y0)) for r in rings],
    }


OUT = pa.schema(
    [
        ("relative_image", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("instance_index", pa.int32()),
        ("class_id", pa.int32()), ("source_kind", pa.string()), ("prompt", pa.string()),
        *((c, pa.float64()) for c in ("sam_score", "stability", "edge_alignment", "leakage", "fragmentation", "fidelity", "quality")),
        *((c, pa.int32()) for c in ("parts", "holes", "points", "lost")),
        ("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))), ("error_type", pa.string()),
        ("error", pa.string()), ("traceback", pa.string()),
    ]
)
OUT_DDL = "relative_image string, width int, height int, instance_index int, class_id int, source_kind string, prompt string, sam_score double, stability double, edge_alignment double, leakage double, fragmentation double, fidelity double, quality double, parts int, holes int, points int, lost int, rings array<array<struct<x:double,y:double>>>, error_type string, error string, traceback string"


def class_profiles(annotations: DataFrame, overrides: dict[int, dict] | None = None) -> dict[int, dict]:
    """Profiles of the classes in use: one small row each, collected for the kernels. annotations: class_id, bbox."""
    boxes = annotations.select("class_id", "bbox.*")
    derived = profiles.derived(profiles.class_stats(boxes))
    rows = {r.class_id: {k: r[k] for k in profiles.FIELDS} for r in derived.collect()}
    return {c: {"max_parts": 0} | p | (overrides or {}).get(c, {}) for c, p in rows.items()}


#: Images in a task of the conversion.
IMAGES_PER_TASK = 32


def refine(images: DataFrame, annotations: DataFrame, folder_uri: str, known: dict[int, dict], settings: Settings, n_images: int) -> DataFrame:
    """Objects of all images that have annotations (rows with an error stand for failed images).

    Tasks get paths and annotations; an image's pixels are read where it is converted.
    """
    default = S.DEFAULT_PROFILE | {"max_parts": 0}
    per = annotations.groupBy("relative_image").agg(F.sort_array(F.collect_list(F.struct("instance_index", "class_id", "kind", "bbox", "polygon"))).alias("annotations"))
    n_tasks = max(images.sparkSession.sparkContext.defaultParallelism, -(-n_images // IMAGES_PER_TASK))
    rows = images.select("relative_image", "width", "height").join(per, "relative_image").repartition(n_tasks, "relative_image")
    make, preset = backends.maker(settings.backend), settings.preset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = None
        for batch in batches:
            for row in batch.to_pylist():
                if backend is None:
                    backend = make()
                    backend.load()
                base = {k: row[k] for k in ("relative_image", "width", "height")}
                try:
                    rgb = pixels(files.read(f"{folder_uri}/{row['relative_image']}"))
                    backend.set_image(rgb)
                    edges = R.edge_map(grey(rgb))
                    out = [
                        base | {
                            "instance_index": a["instance_index"], "class_id": a["class_id"], "source_kind": a["kind"],
                        } | refined(a, known.get(a["class_id"], default), backend, preset, edges) for a in row["annotations"]
                    ]
                except Exception as e:  # a failing image is a result: it is reported, and the others go on
                    out = [base | {"error_type": type(e).__name__, "error": str(e), "traceback": traceback.format_exc()}]
                finally:
                    backend.close_image()
                yield pa.RecordBatch.from_pylist(out, OUT)

    return rows.select("relative_image", "width", "height", "annotations").mapInArrow(run, OUT_DDL)


def triaged(objects: DataFrame, known: dict[int, dict], settings: Settings) -> DataFrame:
    """Adds warnings and state to refined objects; errors are left out."""
    limits = objects.sparkSession.createDataFrame([(c, float(p["max_leakage"])) for c, p in known.items()], "class_id int, max_leakage double")
    good = objects.where("error is null").join(F.broadcast(limits), "class_id", "left")  # one row for each class in use
    limit = F.coalesce("max_leakage", F.lit(S.DEFAULT_PROFILE["max_leakage"]))
    warnings = scoring.warnings(scoring.percent(F.col("fidelity")), limit, settings.review, settings.min_fidelity, F.col("lost"))
    return good.withColumn("warnings", warnings).withColumn("state", scoring.state(settings.accept, settings.review, settings.min_fidelity)).drop("max_leakage")


def report_rows(objects: DataFrame, names: DataFrame) -> DataFrame:
    """The 19 columns of the object report."""
    rows = report.object_report(objects, names).drop("source_kind", "output_label")
    kinds = objects.select(F.col("relative_image").alias("image"), F.col("instance_index").alias("instance"), "source_kind")
    out = rows.join(kinds, ["image", "instance"]).withColumn("output_label", label_path(F.col("image")))
    return out.select([c.split()[0] for c in S.OBJECTS.split(", ")])


def label_path(image):
    """Where an image's label goes in the output: the source tree, images/ read as labels/."""
    parts = F.split(image, "/")
    swapped = F.concat_ws("/", F.transform(parts, lambda p, i: F.when((p == "images") & (i == F.array_position(parts, "images") - 1), "labels").otherwise(p)))
    return L.with_suffix(F.when(F.array_contains(parts, "images"), swapped).otherwise(F.concat(F.lit("labels/"), image)), ".txt")


def settings_row(settings: Settings) -> dict:
    return asdict(settings)
