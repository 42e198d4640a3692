"""Queries over masks: word algebra in Catalyst, raster kernels in Arrow batches, and their oracles where SQL has one.

The masks are the signs of the embeddings: 8 x 8 pixels in one word, five candidates per object. For
contours and morphology they are enlarged sixfold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bits as B
from tessera.functions import raster as R
from tessera.operators import polygons as V
from tessera.operators import report as Z
from tessera.operators import scoring as Q
from tessera.plans.fixtures import duck, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


SCALE = 6
MASKS = "with m as (select vec_id, vec_id//5 as obj, cast(vec_id%5 as int) as cand, cast((vec_id*37)%100 as double)/100 as sam_score, list_transform(embedding, lambda v: v>0) as b, len(list_filter(embedding, lambda v: v>0)) as area from embeddings)"
PAIRS = MASKS + ", pr as (select a.obj, a.cand as a, b.cand as b, a.area as aa, b.area as ba, len(list_filter(list_zip(a.b,b.b), lambda z: z[1] and z[2])) as i from m a join m b on a.obj=b.obj), io as (select *, case when aa+ba-i=0 then cast(1 as double) else i/cast(aa+ba-i as double) end as iou from pr)"
#: One row per set pixel.
PIXELS = MASKS + ", px as (select vec_id, cast(i//8 as int) as y, cast(i%8 as int) as x from m, (select unnest(range(0,64)) as i) where b[i+1])"


def _words(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, obj, cand, sam_score, words)."""
    v = F.col("vec_id")
    return load(spark, d, "embeddings").select(
        v, F.floor(v / 5).alias("obj"), (v % 5).cast("int").alias("cand"),
        (((v * 37) % 100).cast("double") / 100).alias("sam_score"), F.array(B.signs(F.col("embedding"))).alias("words"),
    )


def _small(spark: SparkSession, d: str) -> DataFrame:
    """The same with `mask` as 8 rows of one word each."""
    w = F.get("words", 0)
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.call_function("shiftrightunsigned", w, (y * 8).cast("int")).bitwiseAND(F.lit(255).cast("long")))
    return _words(spark, d).withColumn("mask", F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(8).alias("w"), F.lit(8).alias("h"), rows.alias("words")))


def _large(spark: SparkSession, d: str, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    def f(r: dict) -> dict:
        return {"mask": V.as_mask(np.kron(V.mask_of(r["mask"]), np.ones((SCALE, SCALE), bool)))}

    kind = "struct<x0:int,y0:int,w:int,h:int,words:array<bigint>>"
    return V.mapped(_small(spark, d), f"mask {kind}", f, list(keep), ["mask"])


@query(MASKS + " select vec_id, cast(area as bigint) as area from m")
def mask_area(spark, d):
    return _words(spark, d).select("vec_id", B.area(F.col("words")).alias("area"))


@query(PAIRS + " select obj, a, b, iou from io where a<b")
def mask_iou_pairs(spark, d):
    return Q.pairs(_words(spark, d), ["obj"]).where("a < b").select("obj", "a", "b", "iou")


@query(PIXELS + " select vec_id, min(x) as x0, min(y) as y0, cast(max(x)+1 as int) as x1, cast(max(y)+1 as int) as y1 from px group by 1")
def mask_bbox(spark, d):
    """Tight boxes of the masks that aren't empty: rows by their non-zero words, columns by the union of the rows."""
    m = _small(spark, d).select("vec_id", F.col("mask.words").alias("w"))
    rows = F.filter(F.transform("w", lambda w, i: F.when(w != 0, i)), lambda i: i.isNotNull())
    union = F.aggregate("w", F.lit(0).cast("long"), lambda s, w: s.bitwiseOR(w))
    columns = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda x: F.when(F.call_function("shiftrightunsigned", F.col("u"), x).bitwiseAND(F.lit(1).cast("long")) != 0, x),
        ),
        lambda x: x.isNotNull(),
    )
    out = m.withColumn("u", union).where("u <> 0").withColumn("r", rows).withColumn("c", columns)
    return out.select("vec_id", F.array_min("c").alias("x0"), F.array_min("r").alias("y0"), (F.array_max("c") + 1).alias("x1"), (F.array_max("r") + 1).alias("y1"))


COMPONENTS = PIXELS.replace("with m", "with recursive m") + """, rc(vec_id, y, x, ry, rx) as (select vec_id, y, x, y, x from px union select n.vec_id, n.y, n.x, r.ry, r.rx from rc r join px n on n.vec_id=r.vec_id and abs(n.y-r.y)<=1 and abs(n.x-r.x)<=1 where r.ry*8+r.rx <= n.y*8+n.x or true),
 lb as (select vec_id, y, x, min(ry*8+rx) as label from rc group by 1,2,3), cp as (select vec_id, label, count(*) as area from lb group by 1,2)"""
COMPONENTS = COMPONENTS.replace(" where r.ry*8+r.rx <= n.y*8+n.x or true", "")


@query(COMPONENTS + " select vec_id, count(*) as n, max(area) as largest from cp group by 1")
def mask_components(spark, d):
    """8-connected components: how many, and the largest."""
    rows = V.component_areas(_small(spark, d), ["vec_id"]).where(F.size("areas") > 0)
    return rows.select("vec_id", F.size("areas").cast("long").alias("n"), F.array_max("areas").alias("largest"))


@query(
    COMPONENTS + ", big as (select vec_id, count(*) as n, max(area) as top, sum(area) as total from cp where area>=2 group by 1) select vec_id, case when n<=1 then cast(0 as double) else least(cast(1 as double), 1-top/cast(total as double)+cast(0.05 as double)*(n-1)) end as fragmentation from big"
)
def fragmentation(spark, d):
    parts = V.component_areas(_small(spark, d), ["vec_id"]).select("vec_id", F.explode("areas").alias("area"))
    return Q.fragmentation(parts, ["vec_id"], F.lit(2))


CONSENSUS = PAIRS + """, be as (select obj, arg_max(cand, row(sam_score, -cand)) as best from m group by 1), vo as (select io.obj, io.b as cand from io join be on be.obj=io.obj and io.a=be.best where iou>=cast(0.3 as double)),
 vw as (select m.*, greatest(cast(0.05 as double), sam_score) as weight from m join vo on vo.obj=m.obj and vo.cand=m.cand),
 pv as (select obj, i, sum(case when b[i+1] then weight else 0 end) as yes, sum(weight) as al, count(*) as k from vw, (select unnest(range(0,64)) as i) group by 1,2)
 select pv.obj, max(k) as voters, count(*) filter (where round(yes/al,9)>=cast(0.5 as double)) as area, round(any_value(s.score),6) as score from pv join (select obj, sum(weight*sam_score)/sum(weight) as score from vw group by 1) s on s.obj=pv.obj group by 1 having max(k)>=2"""


@query(CONSENSUS)
def consensus(spark, d):
    """Weighted votes; at a threshold of 0.3, since signs of random vectors overlap little."""
    return Q.consensus(_words(spark, d), ["obj"], 0.3).select("obj", "voters", "area", F.round("score", 6).alias("score"))


STABILITY = PAIRS + """, l as (select obj, a as cand, list_sort(list(iou),'DESC') as v from io group by 1,2), r as (select obj, cand, case when v[1]>cast(0.999 as double) then v[2:] else v end as v from l)
 select obj, cand, round(case when len(v)=0 then 1 else list_avg(v[1:greatest(2,len(v)//3)]) end,6) as stability from r"""


@query(STABILITY)
def stability(spark, d):
    return Q.stability(_words(spark, d), ["obj"]).select("obj", "cand", F.round("stability", 6).alias("stability"))


@query(
    PIXELS + ", n as (select vec_id, count(*) as t, count(*) filter (where x<2 or x>6 or y<2 or y>6) as o from px group by 1) select m.vec_id, case when t is null then cast(1 as double) else o/cast(t as double) end as leakage from m left join n on n.vec_id=m.vec_id"
)
def leakage(spark, d):
    """Share outside the box from (2, 2) to (6, 6)."""
    box = sum(1 << (8 * y + x) for y in range(2, 7) for x in range(2, 7))
    rows = _words(spark, d).withColumn("box", F.array(F.lit(box).cast("long")))
    return rows.select("vec_id", Q.leakage("words", "box").alias("leakage"))


@query(
    PIXELS + ", n as (select vec_id, count(*) filter (where x between 2 and 6 and y between 2 and 6) as i from px group by 1) select m.vec_id, coalesce(i,0)/cast(25 as double) as coverage from m left join n on n.vec_id=m.vec_id"
)
def box_coverage(spark, d):
    """How much of the box from (2, 2) to (6, 6) each mask covers."""
    box = sum(1 << (8 * y + x) for y in range(2, 7) for x in range(2, 7))
    rows = _words(spark, d).withColumn("box", F.array(F.lit(box).cast("long")))
    return rows.select("vec_id", Q.box_coverage("words", "box").alias("coverage"))


@query(
    "select vec_id, cast(len(list_filter(embedding, lambda v: v > case when list_min(embedding)>=0 and list_max(embedding)<=1 then 0.5 else 0 end)) as bigint) as area from embeddings"
)
def binarize(spark, d):
    """Model output to masks: above one half if all values look like probabilities, else above zero."""
    e = load(spark, d, "embeddings")
    finite = F.filter("embedding", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    cut = F.when((F.array_min(finite) >= 0) & (F.array_max(finite) <= 1), 0.5).otherwise(0.0)
    return e.withColumn("cut", cut).select("vec_id", F.size(F.filter("embedding", lambda v: ~F.isnan(v) & (v > F.col("cut")))).cast("long").alias("area"))


BACKENDS = MASKS + ", k as (select vec_id//5 as obj, cand, b, area from m where cand<3), j as (select a.obj, a.cand as ca, c.cand as cc, a.area as aa, c.area as ba, len(list_filter(list_zip(a.b,c.b), lambda z: z[1] and z[2])) as i from k a join k c on a.obj=c.obj and a.cand<c.cand), u as (select 'backend-' || ca as backend_a, 'backend-' || cc as backend_b, case when aa+ba-i=0 then 1 else i/cast(aa+ba-i as double) end as iou from j)"


@query(
    BACKENDS + " select backend_a, backend_b, count(*) as n, round(avg(iou),6) as mean_iou, round(median(iou),6) as median_iou, count(*) filter (where iou<0.5) as below_half from u group by 1,2"
)
def backend_agreement(spark, d):
    """Three backends' masks of the same objects, compared in pairs."""
    name = lambda c: F.concat(F.lit("backend-"), F.col(c).cast("string"))
    p = Q.pairs(_words(spark, d).where("cand < 3"), ["obj"]).where("a < b")
    return Z.agreement(p.withColumn("backend_a", name("a")).withColumn("backend_b", name("b")))


# --- raster kernels


@query(
    COMPONENTS + f" select m.vec_id, cast(coalesce(sum({SCALE * SCALE}*cp.area) filter (where {SCALE * SCALE}*cp.area>=40),0) as bigint) as area from m left join cp on cp.vec_id=m.vec_id group by 1"
)
def despeckle(spark, d):
    """Masks without components of fewer than 40 pixels."""
    return V.mapped(_large(spark, d), "area bigint", lambda r: {"area": int(R.without_small(V.mask_of(r["mask"]), 40).sum())}, ["vec_id"], ["mask"])


def _window(name: str, source: str, low: int, high: int, grow: bool) -> str:
    """Pixels of `source` dilated or eroded by the square from (low, low) to (high, high) around each pixel; only pixels of the frame decide."""
    inside = f"s.y between g.y{low:+d} and g.y{high:+d} and s.x between g.x{low:+d} and g.x{high:+d}"
    size = f"(least(g.y{high:+d},7)-greatest(g.y{low:+d},0)+1)*(least(g.x{high:+d},7)-greatest(g.x{low:+d},0)+1)"
    return f", {name} as (select g.vec_id, g.y, g.x from gr g join {source} s on s.vec_id=g.vec_id and {inside} group by 1,2,3{'' if grow else f' having count(*)={size}'})"


_MORPHED = PIXELS.replace("with m", "with recursive m").replace(", px as (", ", p0 as (") + ", gr as (select vec_id, cast(i//8 as int) as y, cast(i%8 as int) as x from m, (select unnest(range(0,64)) as i))"
_MORPHED += _window("p1", "p0", -1, 1, True) + _window("p2", "p1", -1, 1, False) + _window("p3", "p2", -1, 0, False) + _window("px", "p3", -1, 0, True)
POSTPROCESS = _MORPHED + COMPONENTS[COMPONENTS.index(", rc(") :]


@query(POSTPROCESS + " select m.vec_id, cast(coalesce(sum(cp.area) filter (where cp.area>=3),0) as bigint) as area from m left join cp on cp.vec_id=m.vec_id group by 1")
def postprocess(spark, d):
    """Closing by 3, opening by 2, and removal of components of fewer than 3 pixels."""
    return V.mapped(_small(spark, d), "area bigint", lambda r: {"area": int(R.post_processed(V.mask_of(r["mask"]), 3, 2, 3, False).sum())}, ["vec_id"], ["mask"])


@query()
def mask_polygons(spark, d):
    rows = V.mask_parts(_large(spark, d), ["vec_id"])
    holes = F.aggregate("parts", F.lit(0), lambda s, p: s + F.size(p["holes"]))
    return rows.select("vec_id", F.size("parts").alias("parts"), holes.alias("holes"))


@query()
def simplify(spark, d):
    def f(r: dict) -> dict:
        return {"vertices": sum(len(e) + sum(map(len, h)) for e, h in R.simplified_parts(R.to_parts(V.mask_of(r["mask"])), 1.5))}

    return V.mapped(_large(spark, d), "vertices int", f, ["vec_id"], ["mask"])


@query()
def simplify_fidelity(spark, d):
    def f(r: dict) -> dict:
        m = V.mask_of(r["mask"])
        parts, score = R.to_fidelity(m, R.to_parts(m), 0.95)
        return {"vertices": sum(len(e) + sum(map(len, h)) for e, h in parts), "fidelity": score}

    return V.mapped(_large(spark, d), "vertices int, fidelity double", f, ["vec_id"], ["mask"])


@query("select vec_id, cast(1 as double) as fidelity from embeddings")
def fidelity(spark, d):
    """What the unsimplified parts draw is the mask itself, whatever its holes and islands."""
    return V.mapped(_large(spark, d), "fidelity double", lambda r: {"fidelity": R.fidelity(V.mask_of(r["mask"]), R.to_parts(V.mask_of(r["mask"])))}, ["vec_id"], ["mask"])


@query(MASKS + f" select vec_id, cast(area*{SCALE * SCALE} as bigint) as area from m")
def raster_parts(spark, d):
    def f(r: dict) -> dict:
        m = V.mask_of(r["mask"])
        return {"area": int(R.from_parts(R.to_parts(m), m.shape[1], m.shape[0]).sum())}

    return V.mapped(_large(spark, d), "area bigint", f, ["vec_id"], ["mask"])


#: Corners of quadrilaterals by a number k below 1,000: slanted, self-crossing, partly or wholly outside of a 64 x 64 frame.
CORNERS = ("k%50-5", "k*7%45-3"), ("k*13%75", "k*3%50"), ("k*29%55", "k*11%80-8"), ("k*17%48-20", "k*23%52")
POLYGONS = """with ks as (select distinct o_orderkey%1000 as k from orders), ed as (""" + " union all ".join(f"select k, {ax} as ax, {ay} as ay, {bx} as bx, {by} as by_ from ks" for (ax, ay), (bx, by) in zip(CORNERS, (*CORNERS[1:], CORNERS[0]), strict=True)) + """),
 cr as (select k, y, ceil(ax+((y-ay)*(bx-ax))/cast(by_-ay as double)) as x from (select *, unnest(range(least(ay,by_), greatest(ay,by_))) as y from ed) where y between 0 and 63),
 ins as (select k, y, x from (select cr.k, cr.y, g.x, count(*) filter (where cr.x<=g.x) as n from cr, (select unnest(range(0,64)) as x) g group by 1,2,3) where n%2=1),
 ln as (select *, greatest(abs(bx-ax),abs(by_-ay)) as n from ed), ou as (select k, cast(floor(ay+(by_-ay)*(t/cast(greatest(n,1) as double))+0.5) as bigint) as y, cast(floor(ax+(bx-ax)*(t/cast(greatest(n,1) as double))+0.5) as bigint) as x from (select *, unnest(range(0,n+1)) as t from ln)),
 al as (select k, y, x from ins union select k, y, x from ou where x between 0 and 63 and y between 0 and 63), ar as (select k, count(*) as area from al group by 1)"""


@query(POLYGONS + " select o_orderkey as id, cast(coalesce(area,0) as bigint) as area from orders left join ar on ar.k=o_orderkey%1000")
def raster_polygon(spark, d):
    """Polygons filled by the even-odd rule, with their outlines; each shape is drawn once."""
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 1000).alias("k"))
    shapes = rows.select("k").distinct().withColumn("ring", F.array(*(F.array(F.expr(x), F.expr(y)) for x, y in CORNERS)))
    areas = V.mapped(shapes, "area bigint", lambda r: {"area": int(R.from_polygon(r["ring"], 64, 64).sum())}, ["k"], ["ring"])
    return rows.join(F.broadcast(areas), "k").select("id", "area")  # 1,000 rows at most


def _ringed(spark: SparkSession, d: str) -> DataFrame:
    return V.polygonised(_large(spark, d).withColumn("target", F.lit(0.95)), ["vec_id"])


@query()
def export_rings(spark, d):
    return _ringed(spark, d).select("vec_id", F.size("rings").alias("rings"), F.col("fidelity"), "lost")


@query()
def bridge_holes(spark, d):
    def f(r: dict) -> dict:
        parts = R.to_parts(V.mask_of(r["mask"]), most=1)
        return {"vertices": len(R.bridged(*parts[0])) if parts else 0}

    return V.mapped(_large(spark, d), "vertices int", f, ["vec_id"], ["mask"])


_SHARE = "greatest(cast(0 as double),least(cast(1 as double),({v})/cast({n} as double)))"
_SIX = "(cast(floor(round_even({v}*1e6,0)/1e6) as bigint) || '.' || lpad(cast(cast(round_even({v}*1e6,0) as bigint)%1000000 as varchar),6,'0'))"


def _line(points: list[tuple[str, str]]) -> str:
    numbers = [_SIX.format(v=_SHARE.format(v=v, n=n)) for x, y in points for v, n in ((x, "width"), (y, "height"))]
    return "class_id || ' ' || " + " || ' ' || ".join(numbers)


_BOX = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
_KITE = [("x0-9", "y0"), ("x1*2", "(y0+y1)/3"), ("x0/7", "y1+600")]


@query(
    duck(
        f"select image_id, instance_index, 0 as part, {_line(_BOX)} as line from fx_annotations union all select image_id, instance_index, 1, {_line(_KITE)} from fx_annotations"
    )
)
def label_lines_out(spark, d):
    """Label rows of rings inside and outside of the frame; rings of two points have none."""
    ring = lambda points: F.array(*(F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in points))
    rows = load(spark, d, "fx_annotations").withColumn("rings", F.array(ring(_BOX), ring(_KITE), ring(_BOX[:2])))
    return V.label_rows(rows, ["image_id", "instance_index"])


#: Squared distances of all pixels of the enlarged masks to the nearest unset block, or to outside of the frame.
DEPTHS = MASKS + f""", bl as (select vec_id, cast(i//8 as int) as by_, cast(i%8 as int) as bx, b[i+1] as on_ from m, (select unnest(range(0,64)) as i)),
 pi as (select vec_id, by_*{SCALE}+u as y, bx*{SCALE}+v as x from bl, (select unnest(range(0,{SCALE})) as u), (select unnest(range(0,{SCALE})) as v) where on_),
 fa as (select pi.vec_id, pi.y, pi.x, min(power(greatest(bx*{SCALE}-pi.x,pi.x-bx*{SCALE}-{SCALE - 1},0),2)+power(greatest(by_*{SCALE}-pi.y,pi.y-by_*{SCALE}-{SCALE - 1},0),2)) as far from pi left join bl on bl.vec_id=pi.vec_id and not on_ group by 1,2,3),
 de as (select vec_id, y, x, least(coalesce(far,1e9), power(least(x+1,y+1,{8 * SCALE}-x,{8 * SCALE}-y),2)) as deep from fa)"""


@query(
    DEPTHS + " select m.vec_id, cast(arg_max(x, row(deep,-y,-x)) as double) as x, cast(arg_max(y, row(deep,-y,-x)) as double) as y from m left join de on de.vec_id=m.vec_id group by 1"
)
def interior_point(spark, d):
    def f(r: dict) -> dict:
        at = R.interior_point(V.mask_of(r["mask"]))
        return {"point": at and {"x": float(at[0]), "y": float(at[1])}}

    return V.mapped(_large(spark, d), "point struct<x:double,y:double>", f, ["vec_id"], ["mask"]).select("vec_id", "point.x", "point.y")


def _pixel(dy: int, dx: int) -> str:
    """Whether a pixel beside (y, x) of an enlarged mask is set, frames being mirrored."""
    n = 8 * SCALE
    mirrored = [f"(case when {v}{d:+d}<0 then 1 when {v}{d:+d}>{n - 1} then {n - 2} else {v}{d:+d} end)//{SCALE}" for v, d in (("y", dy), ("x", dx))]
    return f"b[({mirrored[0]})*8+({mirrored[1]})+1]"


def _sobel(along: str) -> str:
    weights = [(dy, dx, (dx if along == "x" else dy) * (2 if (dy if along == "x" else dx) == 0 else 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return "+".join(f"{w}*(case when {_pixel(dy, dx)} then 200 else 30 end)" for dy, dx, w in weights if w).replace("+-", "-")


def _beside(dy: int, dx: int) -> str:
    """The magnitude beside (y, x), 0 outside of the frame."""
    n, step = 8 * SCALE, dy * 8 * SCALE + dx
    value = f"{'lead' if step > 0 else 'lag'}(mag,{abs(step)}) over (partition by vec_id order by y,x)"
    return f"(case when y{dy:+d} between 0 and {n - 1} and x{dx:+d} between 0 and {n - 1} then {value} else 0 end)"


_AHEAD, _BEHIND = ([(0, d), (d, 0), (d, d), (d, -d)] for d in (1, -1))
#: Canny's edges of the enlarged masks, drawn in two greys: gradients, peaks across them, and what hangs together with strong ones.
EDGES = MASKS.replace("with m", "with recursive m") + f""", gd as (select vec_id, b, cast(i//{8 * SCALE} as int) as y, cast(i%{8 * SCALE} as int) as x from m, (select unnest(range(0,{64 * SCALE * SCALE})) as i)),
 gr as (select vec_id, y, x, {_sobel("x")} as gx, {_sobel("y")} as gy from gd), mg as (select *, abs(gx)+abs(gy) as mag, case when abs(gy)<=cast(0.41421356 as double)*abs(gx) then 0 when abs(gy)>cast(2.41421356 as double)*abs(gx) then 1 when (gx>=0)=(gy>=0) then 2 else 3 end as way from gr),
 nb as (select *, case way {" ".join(f"when {k} then {_beside(*d)}" for k, d in enumerate(_AHEAD))} end as ahead, case way {" ".join(f"when {k} then {_beside(*d)}" for k, d in enumerate(_BEHIND))} end as behind from mg),
 pk as (select vec_id, y, x, mag from nb where mag>40 and mag>behind and mag>=ahead),
 sg(vec_id, y, x) as (select vec_id, y, x from pk where mag>120 union select pk.vec_id, pk.y, pk.x from sg join pk on pk.vec_id=sg.vec_id and abs(pk.y-sg.y)<=1 and abs(pk.x-sg.x)<=1),
 eg as (select distinct vec_id, y+dy as y, x+dx as x from sg, (select unnest(range(-2,3)) as dy), (select unnest(range(-2,3)) as dx) where y+dy between 0 and {8 * SCALE - 1} and x+dx between 0 and {8 * SCALE - 1})"""


@query(EDGES + " select m.vec_id, count(eg.y) as area from m left join eg on eg.vec_id=m.vec_id group by 1")
def edge_map(spark, d):
    def f(r: dict) -> dict:
        return {"area": int(R.edge_map(np.where(V.mask_of(r["mask"]), 200, 30)).sum())}

    return V.mapped(_large(spark, d), "area bigint", f, ["vec_id"], ["mask"])


_NEAR = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
_IN = [f"(y{dy:+d} between 0 and {8 * SCALE - 1} and x{dx:+d} between 0 and {8 * SCALE - 1})" for dy, dx in _NEAR]
_SET = [f"{i} and {_pixel(dy, dx)}" for i, (dy, dx) in zip(_IN, _NEAR, strict=True)]
_UNSET = [f"{i} and not {_pixel(dy, dx)}" for i, (dy, dx) in zip(_IN, _NEAR, strict=True)]


@query(
    EDGES + f", bo as (select vec_id, y, x from gd where ({' or '.join(f'({c})' for c in _SET)}) and ({' or '.join(f'({c})' for c in _UNSET)})), al as (select bo.vec_id, count(*) as n, count(eg.y) as on_ from bo left join eg on eg.vec_id=bo.vec_id and eg.y=bo.y and eg.x=bo.x group by 1) select m.vec_id, round(coalesce(on_/cast(n as double),0),9) as value from m left join al on al.vec_id=m.vec_id"
)
def edge_alignment(spark, d):
    def f(r: dict) -> dict:
        m = V.mask_of(r["mask"])
        return {"value": round(R.edge_alignment(m, R.edge_map(np.where(m, 200, 30))), 9)}

    return V.mapped(_large(spark, d), "value double", f, ["vec_id"], ["mask"])


def _ellipses() -> str:
    from tessera.plans.relational import ORACLES as other

    far = "cast(floor(ax*sqrt(greatest(0,1-power(cast(dy as double)/ay,2)))) as bigint)"
    fits = "power(cast({v} as double)/ax,2)+power(cast(dy as double)/ay,2)<=1"
    return f"""with fc as ({other["fallback_candidates"]}), sh as (select distinct ax, ay from fc), ro as (select *, {far} as f from (select *, unnest(range(-ay, ay+1)) as dy from sh)),
 rw as (select ax, ay, case when {fits.format(v="f+1")} then f+1 when {fits.format(v="f")} then f else f-1 end as f from ro), sz as (select ax, ay, cast(sum(2*f+1) as bigint) as area from rw group by 1,2)
 select image_id, instance_index, prompt, area from fc join sz using (ax, ay)"""


@query(_ellipses())
def fallback_masks(spark, d):
    """Area of the placeholder backend's masks; each shape is drawn once."""
    from tessera.plans.relational import fallback_candidates

    rows = fallback_candidates(spark, d).select("image_id", "instance_index", "prompt", "ax", "ay")
    shapes = rows.select("ax", "ay").distinct()
    areas = V.mapped(
        shapes, "area bigint",
        lambda r: {"area": int(R.ellipse(2 * r["ax"] + 3, 2 * r["ay"] + 3, r["ax"] + 1, r["ay"] + 1, r["ax"], r["ay"]).sum())},
        ["ax", "ay"], ["ax", "ay"],
    )
    return rows.join(areas, ["ax", "ay"]).select("image_id", "instance_index", "prompt", "area")


# --- the scores that a conversion computes in its kernels, against the same SQL as those above

SCORES = (
    PIXELS.replace("with m", "with recursive m")
    + PAIRS[len(MASKS) :]
    + STABILITY[len(PAIRS) : STABILITY.index(" select obj, cand, round")]
    + COMPONENTS[COMPONENTS.index(", rc(") :]
    + """, st as (select obj*5+cand as vec_id, round(case when len(v)=0 then 1 else list_avg(v[1:greatest(2,len(v)//3)]) end,6) as stability from r),
 bx as (select greatest(0,2-4*cast(0.15 as double)/2) as lo, least(7,6+4*cast(0.15 as double)/2) as hi),
 lk as (select vec_id, count(*) as t, count(*) filter (where not (x>=floor(lo) and x<floor(hi) and y>=floor(lo) and y<floor(hi))) as o from px, bx group by 1),
 fr as (select vec_id, count(*) as n, max(area) as top, sum(area) as total from cp where area>=2 group by 1),
 sc as (select m.vec_id, sam_score, stability, case when t is null then cast(1 as double) else o/cast(t as double) end as leakage, case when n is null or n<=1 then cast(0 as double) else least(cast(1 as double), 1-top/cast(total as double)+cast(0.05 as double)*(n-1)) end as fragmentation
 from m left join st on st.vec_id=m.vec_id left join lk on lk.vec_id=m.vec_id left join fr on fr.vec_id=m.vec_id),
 qu as (select *, cast(0.38 as double)*sam_score+cast(0.27 as double)*stability+cast(0.13 as double)*0.5+cast(0.10 as double)*(1-leakage)+cast(0.07 as double)*(1-fragmentation)+cast(0.05 as double)*0.25 as base from sc)
 select vec_id, stability, round(leakage,6) as leakage, round(fragmentation,6) as fragmentation, round(greatest(0,least(1,case when leakage>0.2 then base-least(cast(0.12 as double),(leakage-0.2)*cast(0.5 as double)) else base end)),6) as quality from qu"""
)


@query(SCORES)
def object_scores(spark, d):
    """The scores that a conversion's kernels compute, of the same masks as the expressions above: a box from (2, 2) to (6, 6), edges 0.5, agreement 0.25."""
    from tessera.plans import convert as C

    def f(r: dict) -> dict:
        masks = [V.mask_of(c["mask"]) for c in sorted(r["found"], key=lambda c: c["cand"])]
        out = []
        for c, m in zip(sorted(r["found"], key=lambda c: c["cand"]), masks, strict=True):
            v = {"stability": round(C.stability(m, masks), 6), "edge_alignment": 0.5, "leakage": C.leak(m, (2, 2, 6, 6), 8, 8), "fragmentation": C.fragments(m, 2)}
            out.append({"vec_id": c["vec_id"], **{k: v[k] for k in ("stability", "leakage", "fragmentation")}, "quality": C.quality(c["sam_score"], v, 0.25, 0.2)})
        return {"scores": out}

    per = _small(spark, d).groupBy("obj").agg(F.collect_list(F.struct("vec_id", "cand", "sam_score", "mask")).alias("found"))
    rows = V.mapped(per, "scores array<struct<vec_id:bigint,stability:double,leakage:double,fragmentation:double,quality:double>>", f, ["obj"], ["found"])
    each = rows.select(F.inline("scores"))
    return each.select("vec_id", "stability", *(F.round(c, 6).alias(c) for c in ("leakage", "fragmentation", "quality")))
