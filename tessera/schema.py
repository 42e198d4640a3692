"""Table schemas, and the values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
PART = T.StructType([T.StructField("exterior", RING), T.StructField("holes", T.ArrayType(RING))])
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
#: A mask cropped to its region: rows of 64-pixel words, bit i of a word is pixel i.
MASK = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("x0", "y0", "w", "h")), T.StructField("words", T.ArrayType(T.LongType()))])

IMAGES = "image_path string, relative_image string, label_path string, width int, height int"
ISSUES = "relative_image string, line_no int, issue string"
OBJECTS = "image string, instance int, class_id int, class_name string, source_kind string, prompt string, sam_score double, stability double, edge_alignment double, leakage double, fragmentation double, fidelity double, parts int, holes int, points int, quality double, state string, warnings array<string>, output_label string"

# The image suffixes that are read, folders that are not, and the file names of class lists in order.
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
NOT_SOURCES = ("masks", "review_previews", "reports", "labels")
NAME_YAML = ("data.yaml", "dataset.yaml")
NAME_LISTS = ("classes.txt", "obj.names", "predefined_classes.txt")

# Prompt tables by backend and preset: name, growth, shift in x, shift in y.
PROMPTS = {
    "sam2": {
        "fast": [("original box", 0.00, 0.00, 0.00)],
        "balanced": [("original box", 0.00, 0.00, 0.00), ("expand 4%", 0.04, 0.00, 0.00), ("contract 3%", -0.03, 0.00, 0.00)],
        "maximum": [("original box", 0.00, 0.00, 0.00), ("expand 4%", 0.04, 0.00, 0.00), ("contract 3%", -0.03, 0.00, 0.00), ("expand 8%", 0.08, 0.00, 0.00), ("shift left", 0.04, -0.02, 0.00), ("shift right", 0.04, 0.02, 0.00)],
    },
    "sam3": {
        "fast": [("original box", 0.00, 0.00, 0.00)],
        "balanced": [("original box", 0.00, 0.00, 0.00), ("expand 3%", 0.03, 0.00, 0.00), ("contract 2%", -0.02, 0.00, 0.00), ("expand 6%", 0.06, 0.00, 0.00)],
        "maximum": [("original box", 0.00, 0.00, 0.00), ("expand 3%", 0.03, 0.00, 0.00), ("contract 2%", -0.02, 0.00, 0.00), ("expand 6%", 0.06, 0.00, 0.00), ("shift left", 0.05, -0.02, 0.00), ("shift right", 0.05, 0.02, 0.00), ("shift up", 0.05, 0.00, -0.02), ("shift down", 0.05, 0.00, 0.02)],
    },
    "fallback": {
        "fast": [("fallback-1", 0.00, 0.00, 0.00)],
        "balanced": [("fallback-1", 0.00, 0.00, 0.00), ("fallback-2", 0.04, 0.00, 0.00), ("fallback-3", -0.02, 0.00, 0.00)],
        "maximum": [("fallback-1", 0.00, 0.00, 0.00), ("fallback-2", 0.04, 0.00, 0.00), ("fallback-3", -0.02, 0.00, 0.00), ("fallback-4", 0.07, 0.02, 0.00), ("fallback-5", 0.07, -0.02, 0.00)],
    },
}

# The weights of a candidate's quality, and the thresholds of a run.
WEIGHTS = {"sam": 0.38, "stability": 0.27, "edge": 0.13, "inside": 0.10, "whole": 0.07, "agreement": 0.05}
ACCEPT, REVIEW, MIN_FIDELITY, CLUSTER_IOU, LEAK_GROWTH = 0.78, 0.50, 0.90, 0.55, 0.15

# Warnings, and what the review filters look for in them.
WARN_DISAGREE = "Candidate masks disagree"
WARN_LEAK = "Mask extends unusually far outside the YOLO box"
WARN_FRAGMENT = "Mask is fragmented"
WARN_EDGE = "Weak image-edge support"
WARN_QUALITY = "Low overall quality; manual review recommended"
FILTERS = {"disagree": "candidate masks disagree", "edge": "weak image-edge support", "leak": "extends unusually far", "fragmented": "is fragmented", "fidelity": "only reproduces", "quality": "low overall quality"}

# Messages of the label parser.
NOT_NUMERIC = "non-numeric YOLO annotation"
NOT_POSITIVE = "YOLO box width/height must be positive"
DEGENERATE = "degenerate bounding box"
UNSUPPORTED = "unsupported YOLO row: expected class + 4 box values or class + polygon coordinate pairs"

# The default profile of a class.
DEFAULT_PROFILE = {"target_fidelity": 0.980, "min_component_area": 8, "close_kernel": 3, "open_kernel": 0, "preserve_thin": False, "max_leakage": 0.20}
