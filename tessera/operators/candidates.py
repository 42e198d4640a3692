"""Prompts and candidate boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.schema import PROMPTS


def prompt_table(spark: SparkSession, backend: str, preset: str) -> DataFrame:
    """The prompts of a preset (unknown ones count as balanced): a handful of rows."""
    table = PROMPTS[backend]
    rows = table.get(preset, table["balanced" if backend != "fallback" else "fast"])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal int, prompt string, scale double, dx double, dy double")


def prompted(annotations: DataFrame, backend: str, preset: str) -> DataFrame:
    """Every annotation under every prompt of the preset (8 rows at most, so the table is a literal, not a join)."""
    table = PROMPTS[backend]
    rows = table.get(preset, table["balanced" if backend != "fallback" else "fast"])
    specs = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("prompt"), F.lit(s).alias("scale"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for i, (n, s, x, y) in enumerate(rows)))
    wide = annotations.withColumn("_p", F.explode(specs)).select(*annotations.columns, "_p.*")
    box = {c: F.col(c) for c in ("x0", "y0", "x1", "y1")}
    new = G.perturbed(box, F.col("scale"), F.col("dx"), F.col("dy"), F.col("width"), F.col("height"))
    return wide.withColumns({f"p{c}": v for c, v in new.items()})


def fallback(annotations: DataFrame, preset: str) -> DataFrame:
    """Ellipses of the deterministic placeholder backend: centre, semi-axes and score of each candidate."""
    rows = prompted(annotations, "fallback", preset)
    half = lambda lo, hi: F.greatest(F.lit(1), ((F.col(hi) - F.col(lo)) * 0.45).cast("int"))
    return rows.withColumns(
        {
            "cx": ((F.col("px0") + F.col("px1")) / 2).cast("int"), "cy": ((F.col("py0") + F.col("py1")) / 2).cast("int"),
            "ax": half("px0", "px1"), "ay": half("py0", "py1"), "score": 0.70 - F.col("ordinal") * 0.02,
        }
    )


def degenerate(prompts: DataFrame) -> DataFrame:
    """Prompts that a backend must refuse: a coordinate that isn't finite, or a side under one pixel."""
    bad = F.lit(False)
    for c in ("px0", "py0", "px1", "py1"):
        bad = bad | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return prompts.where(bad | (F.col("px1") - F.col("px0") < 1) | (F.col("py1") - F.col("py0") < 1))


def regions(annotations: DataFrame) -> DataFrame:
    box = {c: F.col(c) for c in ("x0", "y0", "x1", "y1")}
    return annotations.withColumns(G.region(box, F.col("width"), F.col("height")))


def focus(annotations: DataFrame, key: str = "image_id") -> DataFrame:
    """Per image the union of its boxes, padded by 0.6 of the longer side and 24 pixels at least."""
    u = annotations.groupBy(key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    pad = F.greatest(F.lit(24.0), 0.6 * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return u.select(key, (F.col("x0") - pad).alias("fx0"), (F.col("y0") - pad).alias("fy0"), (F.col("x1") + pad).alias("fx1"), (F.col("y1") + pad).alias("fy1"))
