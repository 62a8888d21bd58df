import pytest
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.functions import labels
from annolytics.functions.text import to_integer, to_number
from annolytics.operators import items
from annolytics.taxonomy import Taxonomy

THREE = Taxonomy.of(["person", "helmet", "vest"])


def parse(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(labels.parse_lines(F.col("t"), THREE).alias("l")).first()["l"]


@pytest.mark.parametrize(
    "text, ok",
    [("1", True), ("+1", True), ("-0", True), ("1_0", True), ("1.5", False), ("", False), ("1_", False)],
)
def test_integers_are_read_strictly(spark, text, ok):
    found = spark.createDataFrame([(text,)], "t string").select(to_integer(F.col("t"))).first()[0]
    assert (found is not None) == ok


@pytest.mark.parametrize(
    "text, value",
    [("0.5", 0.5), (".5", 0.5), ("5.", 5.0), ("1e-1", 0.1), ("1_0.5", 10.5), ("1d", None), ("1.0f", None),
     ("0x1p3", None), ("abc", None)],
)
def test_numbers_are_read_strictly(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(to_number(F.col("t"))).first()[0] == value


def test_first_failing_rule_wins_and_blank_lines_count(spark):
    found = parse(spark, "\n0 0.5 0.5 0.2 0.2\n\n9 a b c d\nx 1\nx 0 0 0 0\n1 a 0 0 0\n1 nan 2 0 0\n1 2 0 0 0\n1 .5 .5 0 1\n1 0.1 0.5 0.4 0.2\n")
    by_line = {line["line_no"]: (line["code"], line["message"]) for line in found}
    assert by_line[2] == (None, None)
    assert by_line[4] == ("invalid_class_id", "Class ID 9 is not declared in data.yaml.")
    assert by_line[5] == ("invalid_label_format", "Expected 5 values, found 2.")
    assert by_line[6] == ("invalid_class_id", "Class ID must be an integer, found 'x'.")
    assert by_line[7] == ("invalid_bbox", settings.NOT_NUMERIC)
    assert by_line[8] == ("invalid_bbox", settings.NOT_FINITE)
    assert by_line[9] == ("invalid_bbox", settings.CENTRE_OUTSIDE)
    assert by_line[10] == ("invalid_bbox", settings.SIZE_OUTSIDE)
    assert by_line[11] == ("invalid_bbox", settings.EDGE_OUTSIDE)


def test_all_line_breaks_and_whitespace_split(spark):
    found = parse(spark, "0 .5 .5 .1 .1\r\n1\t.5 .5 .1 .1 2 .5 .5 .1 .1\x0b")
    assert [(line["line_no"], line["class_id"], line["code"]) for line in found] == [
        (1, 0, None), (2, 1, None), (3, 2, None)
    ]


def test_edge_tolerance(spark):
    found = parse(spark, "0 0.1 0.5 0.2000010 0.2\n0 0.1 0.5 0.20001 0.2")
    assert [line["code"] for line in found] == [None, "invalid_bbox"]


def test_rewrite_keeps_field_text_and_drops_removed(spark):
    df = spark.createDataFrame([("0  0.50 .5 0.2 0.20\n1 .5 .5 .1 .1\n2 .5 .5 .1 .1",), ("1 .5 .5 .1 .1",)], "t string")
    lines = labels.parse_lines(F.col("t"), THREE)
    out = df.select(labels.file_text(labels.rewrite(labels.valid_lines(lines), {0: 7, 1: None, 2: 3})))
    assert [row[0] for row in out.collect()] == ["7 0.50 .5 0.2 0.20\n3 .5 .5 .1 .1\n", ""]


def test_taxonomy_rules():
    assert Taxonomy.of({"2": "b", 0: "a"}).names == {0: "a", 2: "b"}
    for bad in ([], {-1: "a"}, "abc", {"x": "a"}, None):
        with pytest.raises(ValueError):
            Taxonomy.of(bad)


def test_label_texts_spread_over_all_partitions(spark):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    images = spark.range(400).selectExpr("'train' AS split", "'/ds/train/images/' || id || '.jpg' AS path", "X'FFD8FF' AS content")
    files = spark.range(300).selectExpr("'/ds/train/labels/' || id || '.txt' AS label_path", "encode('0 .5 .5 .1 .1', 'utf-8') AS content")
    joined = items.annotated_items(images, files, "/ds")
    assert joined.rdd.getNumPartitions() == tasks
    assert joined.where("label_present").count() == 300 and joined.count() == 400
    per_task = joined.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == tasks
    nobody = items.annotated_items(images.withColumn("path", F.lit(None).cast("string")), files, "/ds")
    assert nobody.where("NOT label_present").count() == 400
