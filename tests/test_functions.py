import colorsys
import hashlib

import pytest
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.functions import boxes, content, naming, paths
from annolytics.functions.detections import detections
from annolytics.taxonomy import Taxonomy


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "image, label",
    [
        ("/d/images/train/frame.jpg", "/d/labels/train/frame.txt"),
        ("/d/images/Images/x.y.png", "/d/images/labels/x.y.txt"),
        ("/d/train/IMAGES/a.jpeg", "/d/train/labels/a.txt"),
        ("/d/pictures/a.jpg", "/d/labels/pictures/a.txt"),
        ("/elsewhere/a.jpg", "/d/labels/a.txt"),
        ("/d/images", "/d/labels.txt"),
    ],
)
def test_label_path(spark, image, label):
    assert one(spark, paths.label_path(F.lit(image), "/d")) == label


def test_source_key_and_relative_path(spark):
    assert one(spark, paths.source_key(F.lit("/a/x_jpg.rf.1.rf.2.jpg"))) == "x_jpg"
    assert one(spark, paths.source_key(F.lit("/a/x.y.jpg"))) == "x.y"
    assert one(spark, paths.relative_path(F.lit("/a/b/c/x.jpg"), ["/z", "/a/b", "/a"])) == "c/x.jpg"
    assert one(spark, paths.relative_path(F.lit("/q/x.jpg"), ["/z"])) == "x.jpg"


def test_media_type(spark):
    found = [one(spark, paths.media_type(F.lit(n))) for n in ("a.JPG", "a.mp4", "a.txt", "jpg")]
    assert found == ["image", "video", None, None]


def test_class_colour_agrees_with_colorsys(spark):
    found = spark.range(40).select(naming.class_colour(F.col("id"))).collect()
    for class_id, row in enumerate(found):
        rgb = colorsys.hsv_to_rgb(class_id * settings.HUE_STEP % 1.0, 0.78, 0.95)
        assert row[0] == "#" + "".join(f"{round(c * 255):02x}" for c in rgb)


def test_preview_name(spark):
    path = "/d/..we ird (1).jpg"
    digest = hashlib.sha256(path.encode()).hexdigest()[:8]
    assert one(spark, naming.preview_name(F.lit(7), F.lit(path))) == f"sample_007_we_ird_1_{digest}.png"
    assert one(spark, naming.preview_name(F.lit(1234), F.lit("/d/._.png"))).startswith("sample_1234_image_")


def test_iou_and_area(spark):
    def box(*values):
        return tuple(F.lit(float(v)) for v in values)

    assert one(spark, boxes.iou(box(0, 0, 10, 10), box(5, 5, 15, 15))) == 25 / 175
    assert one(spark, boxes.iou(box(0, 0, 10, 10), box(20, 20, 30, 30))) == 0.0
    assert one(spark, boxes.iou(box(1, 1, 1, 1), box(1, 1, 1, 1))) == 0.0
    assert one(spark, boxes.area_ratio(*box(5, 0, 0, 9), F.lit(10), F.lit(10))) == 0.0


def test_pixel_corners_round_half_even_and_clamp(spark):
    found = one(
        spark,
        boxes.pixel_corners(*(F.lit(v) for v in (0.25, 0.5, 0.5, 2.0)), F.lit(5), F.lit(10)),
    )
    assert tuple(found) == (0, 0, 2, 9)


def test_confidence_band(spark):
    found = [one(spark, boxes.confidence_band(F.lit(c))) for c in (0.25, 0.2, 0.1, 0.05)]
    assert found == ["active", "low", "low", None]
    with pytest.raises(ValueError):
        boxes.confidence_band(F.lit(1.0), active=1.5)


def test_detections_are_rounded(spark):
    names = Taxonomy.of({0: "person", 5: "no_helmet"})
    found = one(
        spark,
        detections(
            F.array(F.lit(0.0), F.lit(5.0)),
            F.array(F.lit(0.87654321), F.lit(0.612345)),
            F.array(F.array(*map(F.lit, (1.234, 2.345, 30.0, 40.0))), F.array(*map(F.lit, (5.0, 6.0, 20.0, 21.0)))),
            names,
        ),
    )
    assert [(d["class_id"], d["class_name"], d["confidence"], d["xyxy"]) for d in found] == [
        (0, "person", 0.876543, [1.23, 2.35, 30.0, 40.0]),
        (5, "no_helmet", 0.612345, [5.0, 6.0, 20.0, 21.0]),
    ]


def test_content_rules(spark):
    assert one(spark, content.digest(F.lit(b"x"), "md5")) == hashlib.md5(b"x").hexdigest()
    assert one(spark, content.digest(F.lit(b"x"), "sha512")) == hashlib.sha512(b"x").hexdigest()
    with pytest.raises(ValueError):
        content.digest(F.lit(b"x"), "crc")
    assert one(spark, content.utf8_text(F.lit(b"\x80"))) is None
    for head, ok in ((b"\xff\xd8\xff\xe0", True), (b"RIFF1234WEBPxx", True), (b"not an image", False)):
        assert one(spark, content.looks_like_image(F.lit(head))) is ok
