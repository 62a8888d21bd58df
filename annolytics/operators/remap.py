"""Reconcile and rewrite class taxonomies."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions.labels import bad_lines, class_counts, file_text, rewrite, valid_lines
from annolytics.functions.paths import file_name, relative_path, with_suffix
from annolytics.taxonomy import Taxonomy


def taxonomy_gaps(source_names: DataFrame, rule_names: DataFrame) -> DataFrame:
    """Names without a rule and rules without a name: side (`without_rule`, `unused_rule`), name.
    Both inputs have a `name` column."""
    names, rules = source_names.select("name").distinct(), rule_names.select("name").distinct()
    return (
        names.join(rules, "name", "left_anti")
        .select(F.lit("without_rule").alias("side"), "name")
        .unionByName(
            rules.join(names, "name", "left_anti").select(F.lit("unused_rule").alias("side"), "name")
        )
    )


def id_mapping(
    source: Taxonomy, target: Taxonomy, rules: Mapping[str, str], removed: Collection[str] = ()
) -> dict[int, int | None]:
    """Old id to new id, None for removed classes.  Every class needs a rule and every rule a class."""
    names = set(source.names.values())
    configured = set(rules) | set(removed)
    if names - configured:
        raise ValueError("classes without a mapping rule: " + ", ".join(sorted(names - configured)))
    if configured - names:
        raise ValueError("rules for absent classes: " + ", ".join(sorted(configured - names)))
    return {
        old: target.id_of(rules[name]) if name in rules else None for old, name in source.names.items()
    }


def reject_bad_lines(items: DataFrame) -> DataFrame:
    """Strict mode: the job fails at the first invalid line, undecodable or missing label file."""
    first = F.get(bad_lines(F.col("lines")), 0)
    where = F.concat(F.col("label_path"), F.lit(":"), first["line_no"].cast("string"), F.lit(": "))
    checked = (
        F.when(~F.col("label_present"), F.raise_error(F.concat(F.lit("missing label file: "), "label_path")))
        .when(
            F.col("label_text").isNull(),
            F.raise_error(F.concat(F.lit("label file is not UTF-8: "), F.col("label_path"))),
        )
        .when(first.isNotNull(), F.raise_error(F.concat(where, first["message"])))
        .otherwise(F.col("lines"))
    )
    return items.withColumn("lines", checked)


def remap_labels(
    items: DataFrame, mapping: Mapping[int, int | None], source: Taxonomy, target: Taxonomy
) -> DataFrame:
    """Rewrite the valid lines of every item: adds new_lines, new_text and the arrays old_counts and
    new_counts (annotations per class), without a shuffle."""
    valid = valid_lines(F.col("lines"))
    new_ids = F.transform(
        valid,
        lambda line: F.struct(
            F.create_map(
                *(F.lit(p) for old, new in mapping.items() if new is not None for p in (str(old), new))
            )[line["class_id"].cast("string")].cast("bigint").alias("class_id")
        ),
    )
    return items.withColumns(
        {
            "old_counts": class_counts(valid, source.ids),
            "new_counts": class_counts(new_ids, target.ids),
            "new_lines": rewrite(valid, dict(mapping)),
        }
    ).withColumn("new_text", file_text(F.col("new_lines")))


def remap_accounting(remapped: DataFrame, source: Taxonomy, target: Taxonomy) -> DataFrame:
    """Per split: images, source, written and removed annotations, images left without any, and
    arrays of old and new counts per class."""

    def total(name: str):
        return F.aggregate(F.col(name), F.lit(0).cast("bigint"), lambda acc, n: acc + n)

    return remapped.groupBy("split").agg(
        F.count("*").alias("images"),
        F.sum(total("old_counts")).alias("source_annotations"),
        F.sum(total("new_counts")).alias("written_annotations"),
        F.sum(total("old_counts") - total("new_counts")).alias("removed_annotations"),
        F.count_if(F.size("new_lines") == 0).alias("emptied_images"),
        F.array(*(F.sum(F.get("old_counts", i)) for i in range(len(source.ids)))).alias("old_counts"),
        F.array(*(F.sum(F.get("new_counts", i)) for i in range(len(target.ids)))).alias("new_counts"),
    )


def class_count_rows(accounting: DataFrame, column: str, taxonomy: Taxonomy) -> DataFrame:
    """Explode an array of counts per class into class_id, class_name, annotations over all splits."""
    summed = accounting.agg(
        *(F.sum(F.get(column, i)).alias(f"c{i}") for i in range(len(taxonomy.ids)))
    )
    return summed.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(k).cast("bigint").alias("class_id"),
                        F.lit(taxonomy.names[k]).alias("class_name"),
                        F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("bigint").alias("annotations"),
                    )
                    for i, k in enumerate(taxonomy.ids)
                )
            )
        )
    )


def emptied_images(remapped: DataFrame) -> DataFrame:
    return remapped.where(F.size("new_lines") == 0).select("split", "path")


def output_paths(remapped: DataFrame, sources: Sequence[str], renamed: Mapping[str, str]) -> DataFrame:
    """Add output_split, output_image and output_label, relative to the target folder."""
    split = F.create_map(*(F.lit(p) for pair in renamed.items() for p in pair))[F.col("split")]
    below = relative_path(F.col("path"), sources)
    return remapped.withColumn("output_split", F.coalesce(split, F.col("split"))).withColumns(
        {
            "output_image": F.concat_ws("/", "output_split", F.lit("images"), below),
            "output_label": with_suffix(F.concat_ws("/", "output_split", F.lit("labels"), below), ".txt"),
        }
    )


def name_collisions(outputs: DataFrame, split: str, path: str) -> DataFrame:
    """Output names that two images of one split would share: split, name, images."""
    return (
        outputs.groupBy(F.col(split).alias("split"), file_name(F.col(path)).alias("name"))
        .agg(F.count("*").alias("images"))
        .where(F.col("images") > 1)
    )
