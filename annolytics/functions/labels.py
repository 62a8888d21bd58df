"""Label files: one row holds one file, and its lines stay in that row.

A line is parsed where it is read, so no shuffle is needed to number, judge, count or rewrite the
lines of a file.  Only reports that list lines explode them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.functions.boxes import box_problem
from annolytics.functions.text import is_integer, split_fields, split_lines, strip, to_integer, to_number
from annolytics.taxonomy import Taxonomy


def parse_lines(text: Column, taxonomy: Taxonomy) -> Column:
    """ARRAY<STRUCT<line_no, fields, class_id, box, code, message>> of the non-blank lines.

    `line_no` counts every line from 1, blank ones too.  `code` is null for a valid line; otherwise
    it names the first rule that failed: field count, class id, declared class, numbers, box.
    """
    numbered = F.transform(
        split_lines(text),
        lambda line, position: F.struct(
            (position + 1).alias("line_no"), strip(line).alias("line")
        ),
    )
    split = F.transform(
        F.filter(numbered, lambda row: row["line"] != ""),
        lambda row: F.struct(row["line_no"].alias("line_no"), split_fields(row["line"]).alias("fields")),
    )
    typed = F.transform(
        split,
        lambda row: F.struct(
            row["line_no"].alias("line_no"),
            row["fields"].alias("fields"),
            to_integer(F.get(row["fields"], 0)).alias("class_id"),
            F.transform(F.slice(row["fields"], 2, 4), to_number).alias("box"),
        ),
    )
    # the verdict is worked out once a line, before its two fields are read
    judged = F.transform(typed, lambda row: F.struct(row.alias("row"), _verdict(row, taxonomy).alias("verdict")))
    return F.transform(
        judged,
        lambda line: F.struct(
            *(line["row"][name].alias(name) for name in ("line_no", "fields", "class_id", "box")),
            *(line["verdict"][name].alias(name) for name in ("code", "message")),
        ),
    )


def _verdict(row: Column, taxonomy: Taxonomy) -> Column:
    fields, class_id, box = row["fields"], row["class_id"], row["box"]
    first = F.get(fields, 0)
    problem = box_problem(*(F.get(box, i) for i in range(4)))
    return (
        F.when(
            F.size(fields) != 5,
            _issue(
                "invalid_label_format",
                F.concat(F.lit("Expected 5 values, found "), F.size(fields).cast("string"), F.lit(".")),
            ),
        )
        .when(
            ~is_integer(first),
            _issue(
                "invalid_class_id",
                F.concat(F.lit("Class ID must be an integer, found '"), first, F.lit("'.")),
            ),
        )
        .when(
            class_id.isNull() | ~class_id.isin(taxonomy.ids),
            _issue(
                "invalid_class_id",
                F.concat(
                    F.lit("Class ID "),
                    F.coalesce(class_id.cast("string"), first),
                    F.lit(" is not declared in data.yaml."),
                ),
            ),
        )
        .when(
            F.exists(box, lambda value: value.isNull()),
            _issue("invalid_bbox", F.lit(settings.NOT_NUMERIC)),
        )
        .when(problem.isNotNull(), _issue("invalid_bbox", problem))
    )


def _issue(code: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), message.alias("message"))


def valid_lines(lines: Column) -> Column:
    return F.filter(lines, lambda line: line["code"].isNull())


def bad_lines(lines: Column) -> Column:
    return F.filter(lines, lambda line: line["code"].isNotNull())


def class_counts(lines: Column, class_ids: list[int]) -> Column:
    """ARRAY<BIGINT>: how many of `lines` carry each class id, in the given order."""
    if not class_ids:
        return F.array().cast("array<bigint>")
    wanted = F.array(*(F.lit(k).cast("bigint") for k in class_ids))
    # The lines are the argument of the fold and never captured by a lambda, which would parse them
    # again for every class.
    return F.aggregate(
        F.transform(lines, lambda line: line["class_id"]),
        F.array(*(F.lit(0).cast("bigint") for _ in class_ids)),
        lambda counts, class_id: F.zip_with(
            counts, wanted, lambda n, k: n + F.when(class_id == k, 1).otherwise(0)
        ),
    )


def rewrite(lines: Column, new_ids: dict[int, int | None]) -> Column:
    """ARRAY<STRING>: lines under new ids, in file order; classes mapped to None are dropped and the
    four box fields keep their original text."""
    kept = {old: new for old, new in new_ids.items() if new is not None}
    if not kept:
        return F.array().cast("array<string>")
    mapping = F.create_map(*(F.lit(part) for old, new in kept.items() for part in (str(old), str(new))))
    return F.transform(
        F.filter(lines, lambda line: line["class_id"].isin(list(kept))),
        lambda line: F.concat_ws(
            " ", mapping[line["class_id"].cast("string")], F.array_join(F.slice(line["fields"], 2, 4), " ")
        ),
    )


def file_text(lines: Column) -> Column:
    """Lines joined for writing: a trailing newline only when there is any line."""
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
