"""Queries over the fixture views, and their DuckDB equivalents: sources, dataset, profiles, boxes, scoring, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import geometry as G
from tessera.functions import labels as L
from tessera.operators import candidates as C
from tessera.operators import dataset as D
from tessera.operators import profiles as P
from tessera.operators import report as R
from tessera.operators import scoring as Q
from tessera.plans.fixtures import duck, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = duck(oracle)
        return f

    return register



# --- sources


@query(
    "select image_id, relative_image from fx_images where regexp_matches(lower(relative_image), '[.](jpg|jpeg|png|bmp|tif|tiff|webp)$') and list_contains(string_split(relative_image,'/'),'images') order by relative_image"
)
def image_paths(spark, d):
    """Images below an images/ folder that lies in no output folder, if there is any; else all images."""
    from tessera.sources.images import image_listing

    return image_listing(load(spark, d, "fx_images").select("image_id", F.col("relative_image").alias("path"))).select("image_id", F.col("path").alias("relative_image"))


PATHS = "select image_id, concat('/data/', case when image_id % 3 = 0 then 'a/images/b.c/' when image_id % 3 = 1 then 'images/x/images/' else 'plain/' end, cast(image_id as string), case when image_id % 2 = 0 then '.jpg' else '.v2.png' end) as path from fx_images"
SWAP = r"regexp_replace(concat(case when contains(path,'/images/') then regexp_replace(path, '^(.*)/images/', '\1/labels/') else null end), '[.][^/.]+$', '.txt')"


def _paths(spark, d):
    i = F.col("image_id")
    folder = F.when(i % 3 == 0, "a/images/b.c/").when(i % 3 == 1, "images/x/images/").otherwise("plain/")
    return load(spark, d, "fx_images").select(
        "image_id",
        F.concat(F.lit("/data/"), folder, i.cast("string"), F.when(i % 2 == 0, ".jpg").otherwise(".v2.png")).alias("path"),
    )


CANDIDATES = f"""with p as ({PATHS}), c as (select image_id, 0 as o, case when contains(path,'/images/') then {SWAP} end as c from p
 union all select image_id, 1, regexp_replace(path, '[.][^/.]+$', '.txt') from p
 union all select image_id, 2, regexp_replace(concat('/data/labels/', substr(path, 7)), '[.][^/.]+$', '.txt') from p),
 k as (select image_id, c, min(o) as o from c where c is not null group by 1,2)"""


@query(CANDIDATES + " select image_id, cast(row_number() over (partition by image_id order by o)-1 as int) as ordinal, c as candidate from k")
def label_candidates(spark, d):
    return _paths(spark, d).select("image_id", F.posexplode(L.label_candidates(F.col("path"), F.lit("/data"))).alias("ordinal", "candidate"))


@query(CANDIDATES + " select image_id, coalesce(arg_min(c, o) filter (where length(c) % 4 = 0), arg_min(c, o)) as label_path from k group by image_id")
def label_resolve(spark, d):
    """The first candidate that exists (here: whose length is a multiple of 4), else the first."""
    rows = label_candidates(spark, d)
    files = rows.where(F.length("candidate") % 4 == 0).select(F.col("candidate").alias("file")).distinct()
    found = rows.join(files, F.col("candidate") == F.col("file"), "left").groupBy("image_id").agg(
        F.min_by(F.when(F.col("file").isNotNull(), F.col("candidate")), F.when(F.col("file").isNotNull(), F.col("ordinal"))).alias("hit"),
        F.min_by("candidate", "ordinal").alias("first"),
    )
    return found.select("image_id", F.coalesce("hit", "first").alias("label_path"))


TOKENS = r"""with t as (select *, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') as t from fx_lines),
 v as (select *, len(t)-1 as n, list_transform(t, lambda x: try_cast(x as double)) as v from t where len(t) > 0),
 b as (select *, len(list_filter(v, lambda x: x is null)) > 0 as bad,
  greatest(0.0::double,least((width-1)::double,(v[2]-v[4]/2)*width)) as x0, greatest(0.0::double,least((height-1)::double,(v[3]-v[5]/2)*height)) as y0,
  greatest(0.0::double,least((width-1)::double,(v[2]+v[4]/2)*width)) as x1, greatest(0.0::double,least((height-1)::double,(v[3]+v[5]/2)*height)) as y1 from v),
 p as (select *, case when bad then 'non-numeric YOLO annotation' when n=4 and (v[4]<=0 or v[5]<=0) then 'YOLO box width/height must be positive'
  when n=4 and (x1<=x0 or y1<=y0) then 'degenerate bounding box' when n<>4 and not (n>=6 and n%2=0) then 'unsupported YOLO row: expected class + 4 box values or class + polygon coordinate pairs' end as issue from b)"""


@query(
    TOKENS + " select image_id, line_no, cast(v[1] as int) as class_id, x0, y0, x1, y1, cast(row_number() over (partition by image_id order by line_no)-1 as int) as instance_index from p where issue is null qualify n = 4"
)
def parse_boxes(spark, d):
    """Box rows in pixels; instances are numbered over all valid rows."""
    rows = D.annotations_of(load(spark, d, "fx_lines"))
    return rows.where("kind = 'detection'").select("image_id", "line_no", "class_id", "bbox.*", "instance_index")


POLY = TOKENS + ", q as (select *, [greatest(0.0::double,least((width-1)::double,v[i]*width)) for i in range(2, cast(n+2 as int), 2)] as xs, [greatest(0.0::double,least((height-1)::double,v[i]*height)) for i in range(3, cast(n+2 as int), 2)] as ys from p where issue is null and n<>4)"


@query(POLY + " select image_id, line_no, cast(v[1] as int) as class_id, cast(len(xs) as int) as points, list_sum(xs) as sum_x, list_sum(ys) as sum_y from q")
def parse_polygons(spark, d):
    rows = L.parsed(load(spark, d, "fx_lines")).where("kind = 'polygon'")
    total = lambda c: F.aggregate("polygon", F.lit(0.0), lambda s, p: s + p[c])
    return rows.select("image_id", "line_no", "class_id", F.size("polygon").alias("points"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query(POLY + " select image_id, line_no, list_min(xs) as x0, list_min(ys) as y0, list_max(xs) as x1, list_max(ys) as y1 from q")
def polygon_bbox(spark, d):
    return L.parsed(load(spark, d, "fx_lines")).where("kind = 'polygon'").select("image_id", "line_no", "bbox.*")


@query(TOKENS + " select issue, count(*) as n from p where issue is not null group by 1")
def parse_errors(spark, d):
    return L.parsed(load(spark, d, "fx_lines")).where("issue is not null").groupBy("issue").agg(F.count("*").alias("n"))


@query(
    "select count(*) as n_lines, count(distinct doc_id) as n_docs, cast(sum(length(l)) as bigint) as n_chars from (select doc_id, unnest(string_split(case when text like '%' || chr(10) then substr(text,1,length(text)-1) else text end, chr(10))) as l from documents)"
)
def label_lines(spark, d):
    """Physical lines of text files."""
    rows = load(spark, d, "documents").select("doc_id", F.posexplode(D.lines_of(F.col("text"))).alias("i", "l"))
    return rows.agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"), F.sum(F.length("l")).alias("n_chars"))


@query(TOKENS + " select image_id, relative_image, line_no, 'Line ' || line_no || ': ' || issue as issue from p where issue is not null")
def label_issues(spark, d):
    return D.issues_of(load(spark, d, "fx_lines")).select("image_id", "relative_image", "line_no", "issue")


LAYOUTS = """with i as (select image_id, image_id % 4 as dataset, relative_image as image_path, replace(relative_image, 'images/', 'labels/') as apart from fx_images),
 p as (select *, case when dataset=0 or (dataset=2 and image_id % 3 = 0) then image_path when dataset<3 then apart end as label_path from i)"""


@query(LAYOUTS + """ select dataset, case dataset when 0 then 'images and labels in the same folder' when 1 then 'separate images/ and labels/ folders' when 2 then 'mixed (some labels beside images, some in labels/)' else 'no label files found' end as layout from p group by 1
 union all select cast(-1 as bigint), 'unknown'""")
def layout(spark, d):
    """Datasets of every layout, and one without images."""
    p = load(spark, d, "fx_images").select((F.col("image_id") % 4).alias("dataset"), "image_id", F.col("relative_image").alias("image_path"))
    apart = L.with_suffix(F.regexp_replace("image_path", "^images/", "labels/"), ".txt")
    beside = (F.col("dataset") == 0) | ((F.col("dataset") == 2) & (F.col("image_id") % 3 == 0))
    pairs = p.withColumn("label_path", F.when(beside, L.with_suffix(F.col("image_path"), ".txt")).when(F.col("dataset") < 3, apart))
    return D.layout(pairs, ("dataset",)).unionByName(D.layout(pairs.where("false")).withColumn("dataset", F.lit(-1).cast("long")))


# --- dataset


def _annotations(spark, d):
    return load(spark, d, "fx_annotations").withColumn("kind", F.lit("detection"))


@query("""select (select count(*) from fx_images) as images, (select count(*) from fx_annotations) as objects, (select count(*) from fx_annotations) as boxes, cast(0 as bigint) as polygons,
 (select count(*) from fx_images i where not exists (select 1 from fx_rows r where r.image_id=i.image_id)) as backgrounds, (select count(distinct image_id) from fx_issues) as problems, (select count(distinct image_id) from fx_rows) as labelled""")
def dataset_summary(spark, d):
    return D.summary(load(spark, d, "fx_images"), _annotations(spark, d), load(spark, d, "fx_issues"))


@query("select image_id, relative_image from fx_images where image_id not in (select image_id from fx_annotations) and image_id not in (select image_id from fx_issues)")
def background_images(spark, d):
    return D.background_images(load(spark, d, "fx_images"), _annotations(spark, d), load(spark, d, "fx_issues")).select("image_id", "relative_image")


@query("select image_id, relative_image from fx_images where image_id in (select image_id from fx_issues)")
def problem_images(spark, d):
    return D.problem_images(load(spark, d, "fx_images"), load(spark, d, "fx_issues")).select("image_id", "relative_image")


@query("select image_id, relative_image from fx_images where image_id not in (select image_id from fx_issues)")
def convertible_images(spark, d):
    return D.convertible_images(load(spark, d, "fx_images"), load(spark, d, "fx_issues")).select("image_id", "relative_image")


@query("select class_id, count(*) as n from fx_annotations group by 1 order by 1")
def class_histogram(spark, d):
    return D.class_histogram(_annotations(spark, d))


STATS = """with d as (select class_id, greatest(cast(1 as double),x1-x0) w, greatest(cast(1 as double),y1-y0) h from fx_annotations),
 st as (select class_id, count(*) n, median(w*h) area, median(least(w,h)) mind, median(least(w,h)/greatest(w,h)) thin from d group by class_id)"""


@query(STATS + " select * from st")
def class_stats(spark, d):
    return P.class_stats(_annotations(spark, d))


PROFILES = STATS + """, t as (select *, (thin<cast(0.30 as double) or mind<cast(14 as double)) as is_thin from st), pr as (
select class_id, n, area, mind, thin, is_thin as preserve_thin,
 case when is_thin then 0 else cast(greatest(cast(3 as double),least(cast(9 as double),round_even(mind*cast(0.04 as double),0)*2+1)) as int) end as close_kernel,
 cast(case when is_thin then greatest(cast(2 as double),least(cast(32 as double),round_even(area*cast(0.0005 as double),0))) else greatest(cast(2 as double),least(cast(256 as double),round_even(area*cast(0.001 as double),0))) end as int) as min_component_area,
 case when is_thin then cast(0.995 as double) else greatest(cast(0.965 as double),least(cast(0.985 as double),cast(0.965 as double)+thin*cast(0.02 as double))) end as target_fidelity,
 case when is_thin then cast(0.28 as double) else cast(0.20 as double) end as max_leakage, cast(0 as int) as open_kernel from t)"""


@query(PROFILES + " select * from pr")
def class_profiles(spark, d):
    """The flagship: label rows to per-class post-processing profiles."""
    return P.derived(P.class_stats(_annotations(spark, d)))


@query(PROFILES + """, c as (select unnest(range(0,9)) as class_id) select cast(c.class_id as int) as class_id,
 case when c.class_id in (2,7) then cast(0.97 as double) else coalesce(target_fidelity, cast(0.98 as double)) end as target_fidelity, case when c.class_id in (2,7) then 5 else coalesce(min_component_area,8) end as min_component_area,
 case when c.class_id in (2,7) then 1 else coalesce(close_kernel,3) end as close_kernel, case when c.class_id in (2,7) then 0 else coalesce(open_kernel,0) end as open_kernel,
 case when c.class_id in (2,7) then true else coalesce(preserve_thin,false) end as preserve_thin, case when c.class_id in (2,7) then cast(0.5 as double) else coalesce(max_leakage, cast(0.2 as double)) end as max_leakage,
 case when c.class_id in (2,7) then 'user override' when pr.class_id is not null then 'derived' else 'no samples' end as origin from c left join pr on c.class_id=pr.class_id""")
def profile_resolve(spark, d):
    classes = spark.range(9).select(F.col("id").cast("int").alias("class_id"))
    own = spark.createDataFrame(
        [(c, 0.97, 5, 1, 0, True, 0.5) for c in (2, 7)],
        "class_id int, target_fidelity double, min_component_area int, close_kernel int, open_kernel int, preserve_thin boolean, max_leakage double",
    )
    return P.resolved(classes, class_profiles(spark, d), own)


@query(
    PROFILES + """ select class_id, 'derived (' || case when preserve_thin then 'thin/elongated' else 'compact' end || ', n=' || n || ', thinness=' || printf('%.2f', thin) || ', min_dim=' || printf('%.0f', mind) || 'px)' as origin from pr"""
)
def profile_origin(spark, d):
    return P.with_origin(class_profiles(spark, d)).select("class_id", "origin")


@query("""with nm as (select unnest([0,2,5,10]) as class_id, unnest(['hair','cable','leaf','wire']) as name), c as (select image_id, class_id, count(*) as n from fx_annotations group by 1,2), t as (select image_id, coalesce(name, 'class_' || c.class_id) || ' ×' || n as t from c left join nm on nm.class_id=c.class_id)
 select image_id, string_agg(t, ', ' order by t) as breakdown from t group by 1""")
def image_breakdown(spark, d):
    return D.image_breakdown(_annotations(spark, d), _names(spark))


@query("""with a as (select distinct image_id from fx_annotations), c as (select unnest([(select min(image_id) from a), (select max(image_id) from a), 1601, -5, 10000000000]) as current)
 select current, coalesce(min(image_id) filter (where image_id>current), min(image_id)) as next, coalesce(max(image_id) filter (where image_id<current), max(image_id)) as previous from a, c group by 1""")
def annotated_neighbours(spark, d):
    """Next and previous annotated images of the first, the last, and of keys between and beyond them."""
    images, a = load(spark, d, "fx_images"), _annotations(spark, d)
    ends = a.agg(F.min("image_id").alias("lo"), F.max("image_id").alias("hi"))
    current = ends.select(F.explode(F.array("lo", "hi", *(F.lit(k).cast("long") for k in (1601, -5, 10**10)))).alias("current"))
    return D.neighbours(images, a, current)


@query("select 0 as rank, 'Dataset' as image, 0 as line_no, 'No supported images were found.' as issue union all select 1, relative_image, line_no, issue from fx_issues")
def issue_table(spark, d):
    return D.issue_table(spark.createDataFrame([("No supported images were found.",)], "issue string"), load(spark, d, "fx_issues"))


@query("""with g as (select count(*) as images from fx_images), a as (select count(*) as objects, count(*) filter (where image_id % 3 > 0) as boxes, count(*) filter (where image_id % 3 = 0) as polygons from fx_annotations)
 select 'as it is' as dataset, images, objects, boxes, polygons, (select count(distinct image_id) from fx_issues) as problems, 1 as exit_code from g, a
 union all select 'without problems', images, objects, boxes, polygons, 0, 0 from g, a""")
def verify_output(spark, d):
    """The counts of an output check; any problem makes the exit code 1. Objects of every third image are polygons."""
    images, issues = load(spark, d, "fx_images"), load(spark, d, "fx_issues")
    objects = load(spark, d, "fx_annotations").withColumn("kind", F.when(F.col("image_id") % 3 == 0, "polygon").otherwise("detection"))
    rows = [D.summary(images, objects, x).withColumn("dataset", F.lit(name)) for name, x in (("as it is", issues), ("without problems", issues.where("false")))]
    return rows[0].unionByName(rows[1]).select(
        "dataset", "images", "objects", "boxes", "polygons", "problems",
        F.when(F.col("problems") > 0, 1).otherwise(0).alias("exit_code"),
    )


@query("""with b as (select count(*) as backgrounds from fx_images i where not exists (select 1 from fx_rows r where r.image_id=i.image_id)), o as (select count(*) as objects from fx_annotations), n as (select count(*) as images from fx_images)
 select 'as it is' as dataset, (select count(distinct image_id) from fx_annotations where image_id not in (select image_id from fx_issues)) as ready_images, objects, backgrounds, (select count(distinct image_id) from fx_issues) as problems, 'ready' as status from b, o
 union all select 'without objects', 0, 0, images, 0, 'no objects' from n
 union all select 'all with problems', 0, objects, 0, images, 'all images have problems' from o, n""")
def dataset_status(spark, d):
    """Whether each of three datasets can be converted."""
    images, objects, issues = load(spark, d, "fx_images"), _annotations(spark, d), load(spark, d, "fx_issues")
    bad = images.select("image_id", "relative_image", F.lit(0).alias("line_no"), F.lit("unreadable").alias("issue"))
    out = []
    for name, a, x in (("as it is", objects, issues), ("without objects", objects.where("false"), issues.where("false")), ("all with problems", objects, bad)):
        ready = D.convertible_images(images, x).join(a.select("image_id"), "image_id", "left_semi")
        out.append(D.status(D.summary(images, a, x), ready).withColumn("dataset", F.lit(name)))
    return out[0].unionByName(out[1]).unionByName(out[2])


NAMES = "select unnest([0,2,5,10]) as class_id, unnest(['hair','cable','leaf','wire']) as name"


def _names(spark):
    return spark.createDataFrame([(0, "hair"), (2, "cable"), (5, "leaf"), (10, "wire")], "class_id int, name string")


@query(
    f"with nm as ({NAMES}) select cast(i as int) as class_id, coalesce(name, 'class_' || i) as name from (select unnest(range(0,11)) as i) left join nm on nm.class_id=i"
)
def contiguous_names(spark, d):
    return D.contiguous_names(_annotations(spark, d), _names(spark))


# --- boxes


@query(
    "select image_id, line_no, greatest(cast(0 as double),least(cast(width-1 as double),x0*2-50)) as cx0, greatest(cast(0 as double),least(cast(height-1 as double),y0*2-50)) as cy0 from fx_boxes"
)
def clamp_boxes(spark, d):
    return load(spark, d, "fx_boxes").select(
        "image_id", "line_no", G.clamp(F.col("x0") * 2 - 50, F.col("width") - 1).alias("cx0"),
        G.clamp(F.col("y0") * 2 - 50, F.col("height") - 1).alias("cy0"),
    )


def prompt_sql(backend: str, preset: str, boxes: str = "fx_annotations") -> str:
    rows = " union all ".join(f"select {i} as ordinal, '{n}' as prompt, cast({s} as double) as scale, cast({x} as double) as dx, cast({y} as double) as dy" for i, (n, s, x, y) in enumerate(S.PROMPTS[backend][preset]))
    side = "greatest(cast(1 as double),x1-x0)", "greatest(cast(1 as double),y1-y0)"
    new = lambda c, w, m, sign: f"greatest(cast(0 as double),least(cast({m}-1 as double),{c}{sign}{w}*scale/2+{w}*{'dx' if m == 'width' else 'dy'})) as p{c}"
    return f"with pt as ({rows}) select image_id, instance_index, width, height, ordinal, prompt, {new('x0', side[0], 'width', '-')}, {new('y0', side[1], 'height', '-')}, {new('x1', side[0], 'width', '+')}, {new('y1', side[1], 'height', '+')} from {boxes}, pt"


PROMPTED = ["image_id", "instance_index", "ordinal", "prompt", "px0", "py0", "px1", "py1"]


def _shown(backend: str, preset: str) -> str:
    return f"with q as ({duck(prompt_sql(backend, preset))}) select {', '.join(PROMPTED)} from q"


@query(_shown("sam2", "balanced"))
def perturbed_boxes(spark, d):
    return C.prompted(_annotations(spark, d), "sam2", "balanced").select(*PROMPTED)


@query(_shown("sam2", "maximum"))
def prompt_expand_sam2(spark, d):
    return C.prompted(_annotations(spark, d), "sam2", "maximum").select(*PROMPTED)


@query(_shown("sam3", "maximum"))
def prompt_expand_sam3(spark, d):
    return C.prompted(_annotations(spark, d), "sam3", "maximum").select(*PROMPTED)


@query(
    f"with q as ({duck(prompt_sql('fallback', 'maximum'))}) select image_id, instance_index, prompt, cast(trunc((px0+px1)/2) as int) as cx, cast(trunc((py0+py1)/2) as int) as cy, greatest(1, cast(trunc((px1-px0)*cast(0.45 as double)) as int)) as ax, greatest(1, cast(trunc((py1-py0)*cast(0.45 as double)) as int)) as ay, cast(0.7 as double)-ordinal*cast(0.02 as double) as score from q"
)
def fallback_candidates(spark, d):
    return C.fallback(_annotations(spark, d), "maximum").select("image_id", "instance_index", "prompt", "cx", "cy", "ax", "ay", "score")


@query(f"with q as ({duck(prompt_sql('sam2', 'balanced', 'fx_slivers'))}) select {', '.join(PROMPTED)} from q where px1-px0<1 or py1-py0<1")
def degenerate_prompts(spark, d):
    return C.degenerate(C.prompted(load(spark, d, "fx_slivers").withColumn("kind", F.lit("detection")), "sam2", "balanced")).select(*PROMPTED)


PAD = "greatest(cast(64 as double),x1-x0,y1-y0)"


@query(
    f"select image_id, instance_index, cast(greatest(0,floor(x0-{PAD})) as int) as rx0, cast(greatest(0,floor(y0-{PAD})) as int) as ry0, cast(least(width,ceil(x1+{PAD})) as int) as rx1, cast(least(height,ceil(y1+{PAD})) as int) as ry1 from fx_annotations"
)
def roi_windows(spark, d):
    return C.regions(_annotations(spark, d)).select("image_id", "instance_index", "rx0", "ry0", "rx1", "ry1")


FOCUS = "greatest(cast(24 as double),cast(0.6 as double)*greatest(x1-x0,y1-y0))"


@query(
    f"select image_id, x0-{FOCUS} as fx0, y0-{FOCUS} as fy0, x1+{FOCUS} as fx1, y1+{FOCUS} as fy1 from (select image_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from fx_annotations group by 1)"
)
def focus_rect(spark, d):
    return C.focus(_annotations(spark, d))


# --- rings: the embeddings as closed rings of 32 points

RINGS = """with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
 pt as (select vec_id, i as k, v[2*i+1] as x, v[2*i+2] as y, v[2*((i+1)%32)+1] as nx, v[2*((i+1)%32)+2] as ny from e, (select unnest(range(0,32)) as i)),
 r as (select vec_id, sum(x*ny-nx*y)/2 as area, sum(sqrt((x-nx)*(x-nx)+(y-ny)*(y-ny))) as perim, max(x)-min(x) as w, max(y)-min(y) as h from pt group by 1)"""


def _rings(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    ring = F.transform(F.sequence(F.lit(0), (F.size("embedding") / 2).cast("int") - 1), lambda i: F.struct(F.get(e, 2 * i).alias("x"), F.get(e, 2 * i + 1).alias("y")))
    return load(spark, d, "embeddings").select("vec_id", ring.alias("ring"))


@query(RINGS + " select vec_id, round(area,6) as area from r")
def ring_area(spark, d):
    return _rings(spark, d).select("vec_id", F.round(G.ring_area(F.col("ring")), 6).alias("area"))


@query(RINGS + " select vec_id, round(perim,6) as perimeter from r")
def ring_perimeter(spark, d):
    return _rings(spark, d).select("vec_id", F.round(G.ring_perimeter(F.col("ring")), 6).alias("perimeter"))


@query(
    RINGS + " select vec_id, round(case when abs(area)<=0 or perim<=0 then greatest(1,cast(0.02 as double)*greatest(w,h)*1000) else least(greatest(1,cast(0.02 as double)*greatest(w,h)*1000),greatest(1,3*abs(area)*1000000/(perim*1000))) end,6) as epsilon from r"
)
def epsilon_bound(spark, d):
    b = G.ring_bbox(F.col("ring"))
    rows = _rings(spark, d).select("vec_id", (F.abs(G.ring_area(F.col("ring"))) * 1e6).alias("a"), (G.ring_perimeter(F.col("ring")) * 1000).alias("p"), b.alias("b"))
    extent = F.greatest(F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")) * 1000
    return rows.select("vec_id", F.round(G.epsilon_bound(F.col("a"), F.col("p"), extent), 6).alias("epsilon"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
 h as (select vec_id, j, v[8*j+2*i+1] as x, v[8*j+2*i+2] as y, v[8*j+2*((i+1)%4)+1] as nx, v[8*j+2*((i+1)%4)+2] as ny from e, (select unnest(range(0,8)) as j), (select unnest(range(0,4)) as i)),
 a as (select vec_id, j, abs(sum(x*ny-nx*y)/2) as a from h group by 1,2)
 select vec_id, round(sum(case when j=0 then a else -a end),6) as area from a group by 1""")
def polygon_area(spark, d):
    """Parts of an exterior and seven holes of four points each: |exterior| less |holes|."""
    quads = _rings(spark, d).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.slice("ring", 4 * j + 1, 4)).alias("q"))
    return quads.select("vec_id", F.round(G.part_area(F.get("q", 0), F.slice("q", 2, 7)), 6).alias("area"))


# --- scoring and reports

QUALITY = """with q as (select *, cast(0.38 as double)*greatest(0,least(1,sam_score))+cast(0.27 as double)*stability+cast(0.13 as double)*edge_alignment+cast(0.10 as double)*(1-least(1,leakage))+cast(0.07 as double)*(1-least(1,fragmentation))+cast(0.05 as double)*agreement as base from (select *, cast((image_id*17+instance_index*13) % 101 as double)/100 as agreement, case when class_id % 2 = 0 then cast(0.2 as double) else cast(0.28 as double) end as most from fx_metrics)),
 s as (select *, greatest(0,least(1, case when leakage>most then base-least(cast(0.12 as double),(leakage-most)*cast(0.5 as double)) else base end)) as quality from q),
 w as (select *, list_filter([case when stability<cast(0.65 as double) then 'Candidate masks disagree' end, case when leakage>most then 'Mask extends unusually far outside the YOLO box' end, case when fragmentation>cast(0.30 as double) then 'Mask is fragmented' end,
  case when edge_alignment<cast(0.12 as double) then 'Weak image-edge support' end, case when holes>0 then holes || ' hole(s) could not be encoded as a polygon' end, case when quality<cast(0.5 as double) then 'Low overall quality; manual review recommended' end,
  case when fidelity<cast(0.9 as double) then 'Polygon only reproduces ' || cast(cast(round_even(fidelity*1000,0) as bigint)//10 as varchar) || '.' || cast(cast(round_even(fidelity*1000,0) as bigint)%10 as varchar) || '% of the mask' end], lambda x: x is not null) as warnings,
  case when quality>=cast(0.78 as double) and fidelity>=cast(0.9 as double) then 'accepted' else 'review' end as state from s)"""


def two(c: str) -> str:
    h = f"cast(floor({c}*100+cast(0.5 as double)) as int)"
    return f"({h}//100) || '.' || lpad(cast({h}%100 as varchar),2,'0')"


def _scored(spark, d):
    m = load(spark, d, "fx_metrics")
    agreement = ((F.col("image_id") * 17 + F.col("instance_index") * 13) % 101).cast("double") / 100
    most = F.when(F.col("class_id") % 2 == 0, 0.2).otherwise(0.28)
    q = Q.quality(F.col("sam_score"), F.col("stability"), F.col("edge_alignment"), F.col("leakage"), F.col("fragmentation"), agreement, most)
    rows = m.withColumn("quality", q)
    return rows.withColumn("warnings", Q.warnings(Q.percent(F.col("fidelity")), most, dropped_holes=F.col("holes"))).withColumn("state", Q.state())


@query(QUALITY + " select image_id, instance_index, quality from s")
def quality_score(spark, d):
    return _scored(spark, d).select("image_id", "instance_index", "quality")


@query(QUALITY + " select image_id, arg_max(instance_index, row(quality, -instance_index)) as cand, max(quality) as quality from s group by 1")
def select_best(spark, d):
    rows = _scored(spark, d).withColumn("cand", F.col("instance_index"))
    return Q.select_best(rows, ["image_id"], ["cand", "quality"])


@query(QUALITY + " select image_id, instance_index, array_to_string(warnings,' | ') as warnings from w")
def warnings(spark, d):
    return _scored(spark, d).select("image_id", "instance_index", F.array_join("warnings", " | ").alias("warnings"))


@query(QUALITY + " select state, count(*) as n from w group by 1")
def triage(spark, d):
    return _scored(spark, d).groupBy("state").agg(F.count("*").alias("n"))


@query("select image_id, count(*) as objects, count(*) filter (where (image_id+instance_index)%97=0) as errors from fx_metrics group by 1 having errors>0")
def failed_images(spark, d):
    rows = load(spark, d, "fx_metrics").withColumn("error", F.when((F.col("image_id") + F.col("instance_index")) % 97 == 0, "no candidates"))
    return Q.failed_images(rows)


REPORT = QUALITY + f""", nm as ({NAMES}), rp as (select relative_image as image, instance_index as instance, w.class_id, coalesce(name, 'class_' || w.class_id) as class_name, 'detection' as source_kind, prompt,
 round(sam_score,4) as sam_score, round(stability,4) as stability, round(edge_alignment,4) as edge_alignment, round(leakage,4) as leakage, round(fragmentation,4) as fragmentation, round(fidelity,4) as fidelity, round(quality,4) as quality,
 parts, holes, points, state, array_to_string(warnings,' | ') as warnings, replace(replace(relative_image,'images/','labels/'),'.jpg','.txt') as output_label from w left join nm on nm.class_id=w.class_id)"""


def _report(spark, d):
    return R.object_report(_scored(spark, d), _names(spark))


@query(REPORT + " select * from rp")
def object_report(spark, d):
    return _report(spark, d)


@query(REPORT + " select * from rp where state='review'")
def review_queue(spark, d):
    return _report(spark, d).where("state = 'review'")


@query(REPORT + """ select count(*) as processed_object_rows, count(*) filter (where state='accepted') as accepted, count(*) filter (where state='review') as review, round(avg(quality),4) as mean_quality, round(avg(fidelity),4) as mean_polygon_fidelity,
 min(fidelity) as min_polygon_fidelity, count(*) filter (where fidelity<cast(0.9 as double)) as below_fidelity_threshold, bool_or(prompt like 'fallback%') as placeholder, (select count(*) from fx_images) as images, (select count(distinct image_id) from fx_issues) as failed_images from rp""")
def run_summary(spark, d):
    return R.run_summary(load(spark, d, "fx_images"), _report(spark, d), load(spark, d, "fx_issues").select("image_id").distinct())


@query("select split_part(prompt,' / ',1) as prompt, count(*) as n from fx_metrics group by 1")
def prompts_seen(spark, d):
    return R.prompts_seen(load(spark, d, "fx_metrics"))


@query(REPORT + "".join(f" {'union all' if i else ''} select '{k}' as filter, count(*) filter (where contains(lower(warnings),'{t}')) as n from rp where state='review'" for i, (k, t) in enumerate({"all": "", **S.FILTERS}.items())))
def review_filters(spark, d):
    return R.review_filters(review_queue(spark, d))


@query(
    REPORT + " select image, count(*) as objects, ((2*sum(cast(round(quality*10000) as bigint))+count(*))//(2*count(*)))/cast(10000 as double) as mean_quality, count(*) filter (where state='review') as review from rp group by 1"
)
def image_rollup(spark, d):
    return R.image_rollup(_report(spark, d))


@query(
    QUALITY + ", p as (select image_id, count(*) as objects, count(*) filter (where state='accepted') as accepted from w group by 1) select image_id, count(*) over o as images, cast(sum(objects) over o as bigint) as objects, cast(sum(accepted) over o as bigint) as accepted from p window o as (order by image_id)"
)
def run_stats(spark, d):
    return R.run_stats(_scored(spark, d))


DURATION = "case when s>=3600 then (s//3600) || 'h ' || lpad(cast((s%3600)//60 as varchar),2,'0') || 'm' when s>=60 then (s//60) || 'm ' || lpad(cast(s%60 as varchar),2,'0') || 's' else s || 's' end"


@query(f"with t as (select o_orderkey as id, greatest(0, cast(trunc(o_totalprice) as bigint) % 9000 - 10) as s from orders) select id, {DURATION} as text from t")
def format_duration(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), R.duration(F.col("o_totalprice").cast("long") % 9000 - 10).alias("text"))


@query(
    "select o_orderkey as id, case when o_orderkey%500>1 then round((o_orderkey%77+1)/cast(o_orderkey%500-1 as double),6) end as per_image, case when o_orderkey%500>1 then round((500-o_orderkey%500)*((o_orderkey%77+1)/cast(o_orderkey%500-1 as double)),6) end as remaining from orders"
)
def throughput_eta(spark, d):
    i = F.col("o_orderkey")
    t = R.throughput(i % 500, F.lit(500), (i % 77 + 1).cast("double"))
    return load(spark, d, "orders").select(i.alias("id"), F.round(t["per_image"], 6).alias("per_image"), F.round(t["remaining"], 6).alias("remaining"))


RUNS = "select image_id, instance_index, cast((image_id+instance_index)%3 as int) as b, fidelity, parts, points, stability as quality, case when (image_id+instance_index)%91=0 then 'failed' end as error, cast((image_id*7+instance_index)%50 as double)/100 as seconds from fx_metrics"


def _runs(spark, d):
    k = F.col("image_id") + F.col("instance_index")
    return load(spark, d, "fx_metrics").select(
        "image_id", "instance_index", F.concat(F.lit("backend-"), (k % 3).cast("string")).alias("backend"), "fidelity", "parts",
        "points", F.col("stability").alias("quality"), F.when(k % 91 == 0, "failed").alias("error"),
        (((F.col("image_id") * 7 + F.col("instance_index")) % 50).cast("double") / 100).alias("seconds"),
    )


@query(
    f"select 'backend-' || b as backend, round(avg(quality) filter (where error is null),6) as quality, round(avg(fidelity) filter (where error is null),6) as fidelity, round(avg(parts) filter (where error is null),6) as parts, round(avg(points) filter (where error is null),6) as points, count(error) as failed, round(sum(seconds)/count(*),6) as seconds_per_object from ({RUNS}) group by 1"
)
def backend_summary(spark, d):
    return R.backend_summary(_runs(spark, d))


@query(
    "select image_id, relative_image, instance_index from fx_annotations where image_id not in (select image_id from fx_issues) order by image_id, instance_index limit 100"
)
def sample_objects(spark, d):
    """The first hundred objects of convertible images, in dataset order: the sample that backends are compared on."""
    a = D.convertible_images(_annotations(spark, d), load(spark, d, "fx_issues"))
    return a.orderBy("image_id", "instance_index").limit(100).select("image_id", "relative_image", "instance_index")


@query("select instance_index, prompt, sam_score from fx_metrics where image_id=(select min(image_id) from fx_metrics) order by sam_score desc, instance_index")
def debug_object(spark, d):
    """The candidates of one image, best score first."""
    m = load(spark, d, "fx_metrics")
    first = m.agg(F.min("image_id").alias("image_id"))
    return m.join(F.broadcast(first), "image_id").orderBy(F.desc("sam_score"), "instance_index").select("instance_index", "prompt", "sam_score")


@query("select image_id, relative_image from fx_images where not (image_id%3=0 and image_id%4<>1)")
def resume_pending(spark, d):
    i = load(spark, d, "fx_images")
    return R.pending(i, i.where("image_id % 3 = 0").select("image_id"), i.where("image_id % 4 <> 1")).select("image_id", "relative_image")


@query(
    f"select image_id, instance_index, 'class_' || class_id || '  Q' || {two('stability')} || '  F' || {two('fidelity')} || case when parts>1 then '  x' || parts else '' end as caption from fx_metrics"
)
def overlay_caption(spark, d):
    from tessera.operators.render import caption

    m = load(spark, d, "fx_metrics").withColumn("name", F.concat(F.lit("class_"), F.col("class_id").cast("string"))).withColumn("quality", F.col("stability"))
    return m.select("image_id", "instance_index", caption().alias("caption"))


@query("select image_id, instance_index, parts, holes, points from fx_metrics where points >= 3")
def geometry_counts(spark, d):
    """Parts, holes and vertices of export rings; here rings of known sizes."""
    from tessera.operators.polygons import counts

    m = load(spark, d, "fx_metrics").where("points >= 3")
    point = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    parts = F.transform(
        F.sequence(F.lit(1), F.col("parts")),
        lambda i: F.struct(
            F.array_repeat(point, F.lit(3)).alias("exterior"),
            F.when(
                i == 1, F.array_repeat(F.array_repeat(point, F.lit(4)), F.col("holes")),
            ).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>")).alias("holes"),
        ),
    )
    rows = m.select("image_id", "instance_index", parts.alias("parts"), F.array(F.array_repeat(point, F.col("points"))).alias("rings"))
    return rows.select("image_id", "instance_index", *counts())
