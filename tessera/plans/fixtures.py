"""Annotation tables over the driver's star schema, so that relational operators have volume and an oracle.

Every view has one SQL text, which Spark and DuckDB both run (DuckDB with varchar for string).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_images": """select o_orderkey as image_id,
 concat('images/', case when o_orderkey % 10 = 0 then 'val' else 'train' end, '/', cast(o_orderkey as string), '.jpg') as relative_image,
 cast(640+160*(o_orderkey % 4) as int) as width, cast(480+120*(o_orderkey % 3) as int) as height from orders""",
    "fx_rows": """select l_orderkey as image_id,
 cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate) as int) as line_no,
 cast(l_suppkey % 6 as int) as class_id, l_partkey, l_suppkey, l_linenumber,
 cast(((l_partkey*7919) % 1000)*2+1 as double)/2000 as xc,
 cast(((l_suppkey*104729+l_linenumber*31) % 1000)*2+1 as double)/2000 as yc,
 l_quantity/100 as bw, cast((l_partkey+l_suppkey) % 50 as double)/100 as bh from lineitem""",
    "fx_boxes": """select r.image_id, i.relative_image, i.width, i.height, r.line_no, r.class_id,
 greatest(cast(0 as double),least(cast(width-1 as double),(xc-bw/2)*width)) as x0,
 greatest(cast(0 as double),least(cast(height-1 as double),(yc-bh/2)*height)) as y0,
 greatest(cast(0 as double),least(cast(width-1 as double),(xc+bw/2)*width)) as x1,
 greatest(cast(0 as double),least(cast(height-1 as double),(yc+bh/2)*height)) as y1, bw, bh
 from fx_rows r join fx_images i on r.image_id=i.image_id""",
    "fx_annotations": """select image_id, relative_image, width, height, class_id, x0,y0,x1,y1,
 cast(row_number() over (partition by image_id order by line_no)-1 as int) as instance_index
 from fx_boxes where bw>0 and bh>0 and x1>x0 and y1>y0""",
    # boxes so thin that many prompts made of them are degenerate
    "fx_slivers": """select image_id, instance_index, width, height, class_id, relative_image, x0, y0, x0+(x1-x0)/400 as x1, y1 from fx_annotations""",
    "fx_issues": """select image_id, relative_image, line_no, concat('Line ', cast(line_no as string), ': ',
 case when bw<=0 or bh<=0 then 'YOLO box width/height must be positive' else 'degenerate bounding box' end) as issue
 from fx_boxes where not (bw>0 and bh>0 and x1>x0 and y1>y0)""",
    "fx_metrics": """select image_id, relative_image, class_id, instance_index,
 cast((image_id*31+instance_index*17) % 101 as double)/100 as sam_score,
 cast((image_id*13+instance_index*29) % 101 as double)/100 as stability,
 cast((image_id*7+instance_index*11) % 101 as double)/100 as edge_alignment,
 cast((image_id*3+instance_index*19) % 51 as double)/100 as leakage,
 cast((image_id*5+instance_index*23) % 61 as double)/100 as fragmentation,
 cast(850+((image_id*37+instance_index*41) % 151) as double)/1000 as fidelity,
 cast(1+(image_id+instance_index) % 3 as int) as parts, cast((image_id*2+instance_index) % 2 as int) as holes,
 cast(4+(image_id*11+instance_index*7) % 60 as int) as points,
 case when image_id % 5 = 0 then 'fallback-1' when image_id % 5 = 1 then 'original box / mask 2' else 'consensus(3)' end as prompt
 from fx_annotations""",
    # label files: boxes, polygons, malformed and blank rows; numbers are made of digits, so that both engines write them alike
    "fx_lines": """select r.image_id, i.relative_image, i.width, i.height, r.line_no,
 case when (l_partkey+l_suppkey) % 29 = 3 then 'not numbers here' when (l_partkey+l_suppkey) % 31 = 4 then '   '
 when (l_partkey+l_suppkey) % 37 = 5 then concat(cast(class_id as string), ' 0.5 0.5')
 when (l_partkey+l_suppkey) % 7 = 1 then concat(cast(class_id as string), ' 0.', lpad(cast((l_partkey*7919) % 1000 as string),3,'0'), ' 0.', lpad(cast((l_suppkey*104729) % 1000 as string),3,'0'), ' 0.', lpad(cast((l_partkey*31+7) % 1000 as string),3,'0'), ' 0.', lpad(cast((l_suppkey*17+3) % 1000 as string),3,'0'), ' 1.25 0.', lpad(cast((l_partkey+l_suppkey) % 1000 as string),3,'0'))
 else concat(cast(class_id as string), ' 0.', lpad(cast((l_partkey*7919) % 1000 as string),3,'0'), '  0.', lpad(cast((l_suppkey*104729+l_linenumber*31) % 1000 as string),3,'0'), ' 0.', lpad(cast((l_partkey*13) % 500 as string),3,'0'), ' 0.', lpad(cast((l_partkey+l_suppkey) % 50 as string),3,'0')) end as line
 from fx_rows r join fx_images i on r.image_id=i.image_id""",
}
TABLES = ("orders", "lineitem", "embeddings", "documents", "part", "supplier", "events")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over the tables that it names; nothing is registered in the session."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = spark_sql(name)
    used = [t for t in TABLES if re.search(rf"\bfrom {t}\b", sql)]
    return spark.sql(re.sub(rf"\bfrom ({'|'.join(used)})\b", r"from {\1}", sql), **{t: load(spark, sf_dir, t) for t in used})


def needed(name: str) -> list[str]:
    """The views under a view, itself last."""
    out: list[str] = []
    for other in VIEWS:
        if other != name and other in VIEWS.get(name, ""):
            out += [x for x in needed(other) if x not in out]
    return [*out, name]


def with_views(sql: str) -> str:
    """SQL with the views it names as common table expressions in front."""
    names: list[str] = []
    for v in VIEWS:
        if v in sql:
            names += [x for x in needed(v) if x not in names]
    heads = [f"{v} as ({VIEWS[v]})" for v in names]
    sql = sql.strip()
    if sql.lower().startswith("with "):
        return f"with {', '.join([*heads, sql[5:]])}" if heads else sql
    return f"with {', '.join(heads)} {sql}" if heads else sql


def spark_sql(name: str) -> str:
    return with_views(f"select * from {name}")


def duck(sql: str) -> str:
    """The same for DuckDB."""
    return with_views(sql).replace("as string)", "as varchar)")
