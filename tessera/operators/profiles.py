"""Per-class profiles: medians of box geometry, and the parameters derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schema import DEFAULT_PROFILE

FIELDS = tuple(DEFAULT_PROFILE)


def class_stats(annotations: DataFrame) -> DataFrame:
    """Exact medians per class of area, shorter side and side ratio; sides count as 1 at least."""
    w, h = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    return annotations.select("class_id", w.alias("w"), h.alias("h")).groupBy("class_id").agg(
        F.count("*").alias("n"), F.median(F.col("w") * F.col("h")).alias("area"), F.median(F.least("w", "h")).alias("mind"), F.median(
            F.least("w", "h") / F.greatest("w", "h")
        ).alias("thin")
    )


def derived(stats: DataFrame) -> DataFrame:
    """Thin classes keep their strands: no closing, a low area floor and a high fidelity; others follow their size. Rounding is half to even."""
    clip = lambda x, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))
    is_thin = (F.col("thin") < 0.30) | (F.col("mind") < 14.0)
    rows = stats.withColumn("preserve_thin", is_thin)
    t = F.col("preserve_thin")
    return (
        rows.withColumn("close_kernel", F.when(t, 0).otherwise(clip(F.bround(F.col("mind") * 0.04) * 2 + 1, 3, 9).cast("int")))
        .withColumn("min_component_area", F.when(t, clip(F.bround(F.col("area") * 0.0005), 2, 32)).otherwise(clip(F.bround(F.col("area") * 0.001), 2, 256)).cast("int"))
        .withColumn("target_fidelity", F.when(t, 0.995).otherwise(clip(0.965 + F.col("thin") * 0.02, 0.965, 0.985)))
        .withColumn("max_leakage", F.when(t, 0.28).otherwise(0.20))
        .withColumn("open_kernel", F.lit(0))
    )


def with_origin(profiles: DataFrame) -> DataFrame:
    text = F.format_string(
        "derived (%s, n=%d, thinness=%.2f, min_dim=%.0fpx)",
        F.when(F.col("preserve_thin"), "thin/elongated").otherwise("compact"), F.col("n"), F.col("thin"), F.col("mind"),
    )
    return profiles.withColumn("origin", text)


def resolved(classes: DataFrame, profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Each class's profile: the user's override, else the derived one, else the default."""
    pack = lambda df, name: df.select("class_id", F.struct(*FIELDS).alias(name))
    default = F.struct(*(F.lit(v).alias(k) for k, v in DEFAULT_PROFILE.items()))
    rows = classes.join(pack(overrides, "own"), "class_id", "left").join(pack(profiles, "got"), "class_id", "left")
    origin = F.when(F.col("own").isNotNull(), "user override").when(F.col("got").isNotNull(), "derived").otherwise("no samples")
    kinds = "struct<target_fidelity:double,min_component_area:int,close_kernel:int,open_kernel:int,preserve_thin:boolean,max_leakage:double>"
    return rows.select(
        "class_id", F.coalesce(F.col("own").cast(kinds), F.col("got").cast(kinds), default.cast(kinds)).alias("p"),
        origin.alias("origin"),
    ).select("class_id", "p.*", "origin")
