"""Candidate metrics, consensus, quality, selection and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import bits as B


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def quality(sam: Column, stability: Column, edge: Column, leakage: Column, fragmentation: Column, agreement: Column, max_leakage: Column) -> Column:
    w = S.WEIGHTS
    base = w["sam"] * clip01(sam) + w["stability"] * stability + w["edge"] * edge + w["inside"] * (1 - F.least(F.lit(1.0), leakage)) + w["whole"] * (
        1 - F.least(F.lit(1.0), fragmentation)
    ) + w["agreement"] * agreement
    return clip01(F.when(leakage > max_leakage, base - F.least(F.lit(0.12), (leakage - max_leakage) * 0.5)).otherwise(base))


def select_best(candidates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The candidate of the highest quality; the first one wins ties."""
    best = F.max_by(F.struct(*columns), F.struct("quality", (-F.col("cand")).alias("o"))).alias("b")
    return candidates.groupBy(*keys).agg(best).select(*keys, "b.*")


def warnings(fidelity_text: Column, max_leakage: Column, review: float = S.REVIEW, min_fidelity: float = S.MIN_FIDELITY, dropped_holes: Column | None = None) -> Column:
    """Warnings of an object, in a fixed order."""
    rules = [
        F.when(F.col("stability") < 0.65, S.WARN_DISAGREE),
        F.when(F.col("leakage") > max_leakage, S.WARN_LEAK),
        F.when(F.col("fragmentation") > 0.30, S.WARN_FRAGMENT),
        F.when(F.col("edge_alignment") < 0.12, S.WARN_EDGE),
    ]
    if dropped_holes is not None:
        rules.append(F.when(dropped_holes > 0, F.concat(dropped_holes.cast("string"), F.lit(" hole(s) could not be encoded as a polygon"))))
    rules.append(F.when(F.col("quality") < review, S.WARN_QUALITY))
    rules.append(F.when(F.col("fidelity") < min_fidelity, F.concat(F.lit("Polygon only reproduces "), fidelity_text, F.lit(" of the mask"))))
    return F.array_compact(F.array(*rules))


def percent(x: Column) -> Column:
    """One decimal and a percent sign, rounded half to even on tenths of a percent."""
    tenths = F.bround(x * 1000).cast("long")
    return F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def state(accept: float = S.ACCEPT, review: float = S.REVIEW, min_fidelity: float = S.MIN_FIDELITY) -> Column:
    ok = (F.col("quality") >= accept) & ~(F.col("quality") < review) & ~(F.col("fidelity") < min_fidelity)
    return F.when(ok, "accepted").otherwise("review")


def pairs(masks: DataFrame, keys: list[str]) -> DataFrame:
    """IoU of every two candidates of an object: an equi-join on the object, within its few candidates."""
    m = masks.withColumn("area", B.area(F.col("words")))
    a, b = m.select(
        *keys, F.col("cand").alias("a"), F.col("words").alias("aw"), F.col("area").alias("aa"),
    ), m.select(*keys, F.col("cand").alias("b"), F.col("words").alias("bw"), F.col("area").alias("ba"))
    return a.join(b, keys).withColumn("iou", B.iou(F.col("aw"), F.col("bw"), F.col("aa"), F.col("ba")))


def consensus(masks: DataFrame, keys: list[str], threshold: float = S.CLUSTER_IOU, n_bits: int = 64) -> DataFrame:
    """The weighted vote of the candidates that overlap the best one: score, number of voters, and the voted words.

    Objects whose cluster has fewer than two candidates have none.
    """
    first = Window.partitionBy(*keys).orderBy(F.desc("sam_score"), "cand")
    best = masks.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*keys, F.col("cand").alias("best"))
    voters = pairs(masks, keys).join(best, keys).where(F.col("a") == F.col("best")).where(F.col("iou") >= threshold).select(*keys, F.col("b").alias("cand"))
    rows = masks.join(voters, [*keys, "cand"]).withColumn("weight", F.greatest(F.lit(0.05), F.col("sam_score")))
    votes = F.transform(
        F.sequence(F.lit(0), F.size("words") * n_bits - 1),
        lambda i: F.get(F.col("words"), (i / n_bits).cast("int")).bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("long"), (i % n_bits).cast("int"))
        ) != 0,
    )
    pixels = rows.select(*keys, "cand", "weight", "sam_score", F.posexplode(votes).alias("pixel", "on"))
    per = pixels.groupBy(*keys, "pixel").agg(
        F.sum(F.when(F.col("on"), F.col("weight")).otherwise(0.0)).alias("yes"), F.sum("weight").alias("all"),
        F.count("*").alias("k"),
    )
    kept = per.groupBy(*keys).agg(F.max("k").alias("voters"), F.count_if(F.round(F.col("yes") / F.col("all"), 9) >= 0.5).alias("area"))
    score = rows.groupBy(*keys).agg((F.sum(F.col("weight") * F.col("sam_score")) / F.sum("weight")).alias("score"))
    return kept.where("voters >= 2").join(score, keys)


def stability(masks: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of a candidate's best overlaps with all candidates, itself left out."""
    lists = pairs(masks, keys).groupBy(*keys, F.col("a").alias("cand")).agg(F.sort_array(F.collect_list("iou"), False).alias("v"))
    rest = F.when(F.get("v", 0) > 0.999, F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))).otherwise(F.col("v"))
    rows = lists.withColumn("v", rest).withColumn("n", F.size("v"))
    k = F.least(F.col("n"), F.greatest(F.lit(2), F.floor(F.col("n") / 3).cast("int")))
    top = F.slice("v", 1, k)
    return rows.select(
        *keys, "cand",
        F.when(F.col("n") == 0, 1.0).otherwise(F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.greatest(k, F.lit(1))).alias("stability"),
    )


def leakage(mask: str, grown_box: str) -> Column:
    """Share of a mask outside its grown box, both as words; an empty mask leaks whole."""
    total = B.area(F.col(mask))
    return F.when(total == 0, 1.0).otherwise((total - B.overlap(F.col(mask), F.col(grown_box))) / total)


def box_coverage(mask: str, box: str) -> Column:
    """Share of a box that a mask covers, both as words; nothing of an empty box."""
    size = B.area(F.col(box))
    return F.when(size == 0, 0.0).otherwise(B.overlap(F.col(mask), F.col(box)) / size)


def fragmentation(components: DataFrame, keys: list[str], min_area: Column) -> DataFrame:
    """From component areas: 0 for one piece, else the share outside the largest piece and 0.05 for each further one."""
    big = components.where(F.col("area") >= F.greatest(F.lit(2), min_area)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("area").alias("top"), F.sum("area").alias("total"),
    )
    return big.select(
        *keys,
        F.when(F.col("n") <= 1, 0.0).otherwise(
            F.least(F.lit(1.0), 1 - F.col("top") / F.col("total") + 0.05 * (F.col("n") - 1))
        ).alias("fragmentation"),
    )


def failed_images(objects: DataFrame, key: str = "image_id") -> DataFrame:
    """All or nothing: an image fails if any of its objects did."""
    return objects.groupBy(key).agg(F.count("*").alias("objects"), F.count_if(F.col("error").isNotNull()).alias("errors")).where("errors > 0")
