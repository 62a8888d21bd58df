"""Defaults of the library.  Every operator takes them as arguments; none reads them implicitly."""

from __future__ import annotations

# --- Fixed values: names, ids, formats and thresholds that results must agree on -----------------

IMAGE_EXTENSIONS = (".bmp", ".dng", ".jpeg", ".jpg", ".mpo", ".png", ".tif", ".tiff", ".webp")
PHOTO_SUFFIXES = (".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
VIDEO_SUFFIXES = (".avi", ".m4v", ".mkv", ".mov", ".mp4", ".webm")

SPLIT_ALIASES = {"train": ("train",), "val": ("val", "validation"), "test": ("test",)}
PUBLISHED_SPLIT_NAMES = {"train": "train", "val": "valid", "test": "test"}
OUTPUT_SPLITS = ("train", "valid", "test")
SPLIT_RATIOS = {"train": 0.70, "valid": 0.20, "test": 0.10}

TARGET_CLASSES = (
    "person", "helmet", "vest", "gloves", "boots",
    "no_helmet", "no_vest", "no_gloves", "no_boots",
)
CLASS_SYNONYMS = {
    "Human": "person",
    "Helmet": "helmet",
    "helmet": "helmet",
    "hat": "helmet",
    "Safety Vest": "vest",
    "vest": "vest",
    "Gloves": "gloves",
    "gloves": "gloves",
    "Safety Boot": "boots",
    "boots": "boots",
    "no hat": "no_helmet",
    "no vest": "no_vest",
    "no gloves": "no_gloves",
    "no boot": "no_boots",
    "no boots": "no_boots",
}
REMOVED_SOURCE_CLASSES = ("glasses",)
FINAL_CLASSES = ("person", "helmet", "vest", "gloves", "boots", "no_helmet", "no_vest")
REMOVED_FINAL_CLASSES = ("no_gloves", "no_boots")
VIOLATION_CLASSES = ("no_helmet", "no_vest")

ERROR_CATEGORIES = (
    "low_confidence",
    "suspected_missed_detection",
    "suspected_false_positive",
    "class_confusion",
    "small_object_failure",
    "occlusion_scene_failure",
    "dense_scene_failure",
)

ISSUE_SEVERITY = {
    "missing_split": "error",
    "missing_split_path": "error",
    "empty_split": "warning",
    "missing_image": "error",
    "unreadable_image": "error",
    "missing_label": "error",
    "unreadable_label": "error",
    "empty_label": "warning",
    "invalid_label_format": "error",
    "invalid_class_id": "error",
    "invalid_bbox": "error",
    "duplicate_image": "warning",
}

NOT_FINITE = "bounding-box values must be finite numbers"
CENTRE_OUTSIDE = "x_center and y_center must be within [0, 1]"
SIZE_OUTSIDE = "width and height must be within (0, 1]"
EDGE_OUTSIDE = "bounding box extends outside normalized image boundaries"
NOT_NUMERIC = "Bounding-box values must be numeric."
EDGE_TOLERANCE = 1e-6

ACTIVE_CONFIDENCE = 0.25
LOW_CONFIDENCE = 0.10
EVALUATION_CONFIDENCE = 0.001
MATCH_IOU = 0.50
OCCLUSION_IOU = 0.10
SMALL_AREA_RATIO = 0.01
DENSE_OBJECTS = 8
EXAMPLES_PER_CATEGORY = 20

DEFAULT_FPS = 25.0
MAX_VIDEO_SECONDS = 120.0
VIOLATION_SAMPLES = 100

HUE_STEP = 0.618033988749895
COLOUR_SATURATION = 0.78
COLOUR_VALUE = 0.95

# Messages about the sources of a specification.
NO_SPLIT = "No '{split}' split is defined."
NO_SPLIT_PATH = "Split path does not exist: {source}"
NO_IMAGES = "No supported images found in: {source}"

# Leading bytes (hex) of the raster formats behind IMAGE_EXTENSIONS; RIFF also needs WEBP at byte 9.
IMAGE_SIGNATURES = ("424D", "FFD8FF", "89504E470D0A1A0A", "49492A00", "4D4D002A")
WEBP_SIGNATURE = r"^52494646.{8}57454250"

# Line and field separators that text files may use (the full Unicode sets).
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
# --- end of fixed values --------------------------------------------------------------------------
