"""Label rows and dataset paths as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions.geometry import clamp, ring_bbox

#: What Python's float() accepts, apart from digit separators.
NUMBER = r"^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))$"
#: Line ends of str.splitlines.
LINE_END = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"
BLANKS = "(?U)[\\s\\x1c-\\x1f]+"


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, BLANKS), lambda t: t != "")


def number(token: Column) -> Column:
    return F.when(token.rlike(NUMBER), F.when(F.lower(token).rlike("nan$"), F.lit(float("nan"))).otherwise(token.try_cast("double")))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def parse(line: Column, w: Column, h: Column) -> Column:
    """One label row as a struct: valid, class_id, kind, bbox, polygon, and issue (null if the row is valid or blank)."""

    def row(v: Column) -> Column:
        at = lambda i: F.get(v, i)
        n = F.size(v) - 1
        cls = F.when(~F.isnan(at(0)) & (F.abs(at(0)) < 2147483648.0), at(0).cast("int"))
        is_box, is_polygon = n == 4, (n >= 6) & (n % 2 == 0)
        box = F.struct(
            clamp((at(1) - at(3) / 2) * w, w - 1).alias("x0"), clamp((at(2) - at(4) / 2) * h, h - 1).alias("y0"),
            clamp((at(1) + at(3) / 2) * w, w - 1).alias("x1"), clamp((at(2) + at(4) / 2) * h, h - 1).alias("y1"),
        )
        pairs = F.transform(
            F.sequence(F.lit(0), F.greatest((n / 2).cast("int") - 1, F.lit(0))),
            lambda i: F.struct(clamp(F.get(v, 2 * i + 1) * w, w - 1).alias("x"), clamp(F.get(v, 2 * i + 2) * h, h - 1).alias("y")),
        )

        def judged(p: Column) -> Column:
            b = p["box"]
            issue = (
                F.when(F.size(v) == 0, F.lit(None).cast("string"))
                .when((F.size(F.filter(v, lambda x: x.isNull())) > 0) | p["cls"].isNull(), S.NOT_NUMERIC)
                .when(is_box & ((at(3) <= 0) | (at(4) <= 0)), S.NOT_POSITIVE)
                .when(is_box & ((b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"])), S.DEGENERATE)
                .when(~is_box & ~is_polygon, S.UNSUPPORTED)
            )

            def result(i: Column) -> Column:
                valid = i.isNull() & (F.size(v) > 0)
                return F.struct(
                    valid.alias("valid"), F.when(valid, p["cls"]).alias("class_id"),
                    F.when(valid & is_box, "detection").when(valid, "polygon").alias("kind"),
                    F.when(valid & is_box, b).when(valid, ring_bbox(p["polygon"])).alias("bbox"),
                    F.when(valid & is_polygon, p["polygon"]).alias("polygon"), i.alias("issue"),
                )

            return let(issue, result)

        return let(F.struct(cls.alias("cls"), F.when(is_box, box).alias("box"), F.when(is_polygon, pairs).alias("polygon")), judged)

    return let(F.transform(tokens(line), number), row)


def parsed(rows: DataFrame, line: str = "line", width: str = "width", height: str = "height") -> DataFrame:
    """Adds valid, class_id, kind, bbox, polygon and issue to label rows.

    The struct goes through a generator of one row, so that filters on its fields stay above and don't parse each row again.
    """
    one = F.explode(F.array(parse(F.col(line), F.col(width), F.col(height)))).alias("_row")
    return rows.select("*", one).select(*rows.columns, "_row.*")


def with_suffix(path: Column, suffix: str) -> Column:
    """Replaces a path's last suffix, or appends one."""
    return F.when(path.rlike(r"[^/.][^/]*\.[^/.]+$"), F.regexp_replace(path, r"\.[^/.]+$", suffix)).otherwise(F.concat(path, F.lit(suffix)))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def label_candidates(path: Column, root: Column) -> Column:
    """Where an image's label can be, in order: beside its last images/ folder, beside itself, under the root's labels/."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    last = F.size(folders) - F.array_position(F.reverse(folders), "images") + 1  # 1-based place of the last one
    swapped = F.when(
        F.array_contains(folders, "images"),
        with_suffix(
            F.concat_ws("/", F.slice(parts, 1, last.cast("int") - 1), F.lit("labels"), F.slice(parts, last.cast("int") + 1, F.size(parts))),
            ".txt",
        ),
    )
    relative = F.substring(path, F.length(root) + 2, F.length(path))
    return F.array_distinct(F.array_compact(F.array(swapped, with_suffix(path, ".txt"), with_suffix(F.concat(root, F.lit("/labels/"), relative), ".txt"))))
