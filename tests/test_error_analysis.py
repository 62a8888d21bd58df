"""From image headers, label lines and predictions to errors and their reports."""

import struct
import time

import pytest
from pyspark.sql import functions as F

from annolytics.functions.content import image_size
from annolytics.operators.items import image_facts
from annolytics.plans import dataset_jobs as jobs
from datasets import write_label, write_spec

FOLDERS = {"train": "train/images", "val": "valid/images", "test": "test/images"}


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\x08\x02\0\0\0"


def jpeg(width, height, *segments, frame=0xC0):
    body = b"".join(struct.pack(">BBH", 0xFF, m, 2 + len(data)) + data for m, data in segments)
    return b"\xff\xd8" + body + struct.pack(">BBHBHHB", 0xFF, frame, 17, 8, height, width, 3) + b"\0" * 9


def bmp(width, height):
    return b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, width, height)


def webp(kind, data):
    return b"RIFF\0\0\0\0WEBP" + kind + struct.pack("<I", len(data)) + data


SIZES = {
    "png": (png(70_000, 3), (70_000, 3)),
    "no_ihdr": (b"\x89PNG\r\n\x1a\n" + b"\0" * 20, None),
    "cut_png": (png(5, 6)[:20], (5, None)),
    "jpeg": (jpeg(641, 427, (0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")), (641, 427)),
    "progressive": (jpeg(9, 8, (0xE1, b"\xff\xc0" * 40), (0xDB, b"\0" * 65), frame=0xC2), (9, 8)),
    "tables_first": (jpeg(9, 8, (0xC4, b"\0\1\2\3\4\5\6\7"), (0xCC, b"\0" * 9), frame=0xC9), (9, 8)),
    "many_segments": (jpeg(65_535, 1, *[(0xFE, b"%03d" % i) for i in range(300)]), (65_535, 1)),
    "long_segment": (jpeg(12, 34, (0xE2, b"\xff\xc0" * 32_000)), (12, 34)),
    "filled": (b"\xff\xd8\xff\xff" + jpeg(7, 5)[2:], (7, 5)),
    "scan_first": (b"\xff\xd8\xff\xda\0\2" + jpeg(7, 5)[2:], None),
    "cut_jpeg": (jpeg(7, 5)[:8], None),
    "bmp": (bmp(31, 17), (31, 17)),
    "bmp_from_top": (bmp(31, -17), (31, 17)),
    "webp_lossy": (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 800 | 1 << 14, 600)), (800, 600)),
    "webp_lossless": (webp(b"VP8L", b"\x2f" + struct.pack("<I", 799 | 599 << 14 | 1 << 28)), (800, 600)),
    "webp_extended": (webp(b"VP8X", b"\0\0\0\0" + (19_999).to_bytes(3, "little") + (2).to_bytes(3, "little")), (20_000, 3)),
    "text": (b"not an image", None),
    "empty": (b"", None),
    "null": (None, None),
}


def test_sizes_from_headers(spark):
    rows = spark.createDataFrame([(n, c) for n, (c, _) in SIZES.items()], "name string, content binary")
    found = {r["name"]: r["s"] for r in rows.repartition(2).select("name", image_size(F.col("content")).alias("s")).collect()}
    for name, (_, expected) in SIZES.items():
        size = None if found[name] is None or found[name] == (None, None) else tuple(found[name])
        assert size == expected, name


def test_sizes_are_one_more_fact(spark):
    rows = spark.createDataFrame([("a", png(3, 2)), ("b", None)], "path string, content binary")
    with_size, without = image_facts(rows, sizes=True), image_facts(rows)
    assert with_size.columns == [*without.columns[:1], "width", "height", *without.columns[1:]]
    assert {r["path"]: (r["width"], r["height"]) for r in with_size.collect()} == {"a": (3, 2), "b": (None, None)}


def scene(tmp_path):
    """A test split of a PNG with three boxes, a JPEG with one, and a TIFF without any."""
    root = tmp_path / "scene"
    contents = {"hall.png": png(200, 100), "gate.jpg": jpeg(400, 400, (0xE0, b"x")), "sky.tif": b"II*\0"}
    for split in ("train", "valid", "test"):
        for name, content in contents.items():
            path = root / split / "images" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content + split.encode())
        write_label(root / split / "labels/hall.txt", "0 0.25 0.5 0.2 0.4\n1 0.75 0.5 0.2 0.4\n2 0.5 0.1 0.05 0.1\n")
        write_label(root / split / "labels/gate.txt", "1 0.5 0.5 0.5 0.5\n")
        write_label(root / split / "labels/sky.txt", "")
    return root, write_spec(tmp_path / "data.json", root, ["person", "helmet", "vest"], **FOLDERS)


def test_labels_and_predictions_become_errors_and_reports(spark, tmp_path):
    root, spec = scene(tmp_path)
    hall, gate = (str(root / "test/images" / n) for n in ("hall.png", "gate.jpg"))
    predictions = spark.createDataFrame(
        [
            (hall, 1, 0, 30.0, 30.0, 70.0, 70.0, 0.9),  # box 0 exactly: (0.25 -+ 0.1) * 200, (0.5 -+ 0.2) * 100
            (hall, 2, 2, 130.0, 30.0, 170.0, 70.0, 0.8),  # the place of box 1, another class
            (hall, 3, 2, 130.0, 30.0, 170.0, 70.0, 0.15),  # low
            (gate, 1, 1, 100.0, 100.0, 300.0, 300.0, 0.5),
        ],
        "path string, idx long, class_id long, x1 double, y1 double, x2 double, y2 double, conf double",
    )
    report = tmp_path / "report"
    tables = jobs.analyse_errors(spark, spec, predictions, report=str(report))
    events = {r["category"]: (r["events"], r["images"]) for r in tables["categories"].collect()}
    assert events == {
        "low_confidence": (1, 1),
        "suspected_missed_detection": (2, 1),
        "suspected_false_positive": (1, 1),
        "class_confusion": (1, 1),
        "small_object_failure": (1, 1),
        "occlusion_scene_failure": (0, 0),
        "dense_scene_failure": (0, 0),
    }
    assert {r["image_id"] for r in tables["examples"].collect()} == {hall}
    written = spark.read.option("header", True).csv(f"{report}/categories")
    assert {r["category"]: (int(r["events"]), int(r["images"])) for r in written.collect()} == events
    (run,) = spark.read.json(f"{report}/run").collect()
    assert run["elapsed_seconds"] > 0 and run["started"] < run["finished"]
    assert run["rows"].asDict() == {"images": 2, "categories": 7, "examples": tables["examples"].count()}
    with pytest.raises(FileExistsError):
        jobs.analyse_errors(spark, spec, predictions, report=str(report))


def test_an_annotated_image_of_unknown_size_stops_the_job(spark, tmp_path):
    root, spec = scene(tmp_path)
    write_label(root / "test/labels/sky.txt", "0 0.5 0.5 0.1 0.1\n")
    none = spark.createDataFrame([], "path string, idx long, class_id long, x1 double, y1 double, x2 double, y2 double, conf double")
    with pytest.raises(Exception, match="image size is unknown"):
        jobs.analyse_errors(spark, spec, none)


def test_the_audit_writes_its_reports(spark, tmp_path):
    _, spec = scene(tmp_path)
    tables = jobs.validate_dataset(spark, spec, report=str(tmp_path / "audit"))
    written = spark.read.option("header", True).csv(str(tmp_path / "audit/issue_counts"))
    assert written.count() == tables["issue_counts"].count()
    (run,) = spark.read.json(str(tmp_path / "audit/run")).collect()
    assert run["rows"]["classes"] == 9


def test_a_walk_ends_with_its_header(spark):
    """Many segments before the frame cost no more than twice their number, however long the file is."""
    long = jpeg(640, 480, *[(0xFE, b"")] * 99) + b"\0" * 4_000_000
    df = spark.createDataFrame([(bytearray(long),), (bytearray(long[:200]),), (bytearray(b"\xff\xd8\xff"),)], "content binary")
    begun = time.monotonic()
    assert [tuple(r[0]) for r in df.select(image_size(F.col("content"))).collect()] == [(640, 480), (None, None), (None, None)]
    assert time.monotonic() - begun < 30
