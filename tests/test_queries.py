"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
CHECKED = [
    "annotation_counts_by_split_class", "validation_issues", "validation_rollup", "duplicate_members",
    "label_paths", "taxonomy_diff", "remap_labels", "remap_counts", "removed_files", "split_assignment",
    "split_objective", "dataset_digest", "dataset_tree_digest", "manifest_status", "freeze_summary",
    "greedy_matches", "error_categories", "average_precision", "latency_summary", "run_summary",
    "comparison_headline", "session_summary", "violation_frames_stream", "preview_sample", "pixel_boxes",
    "manifest_verification", "dedup_kept", "attempts", "error_examples_topk", "class_confusions",
    "overlapping_truth", "session_summary_stream", "violation_rate_stream",
    "split_best_moves", "split_refinement_check", "image_sizes", "truth_from_labels",
    "error_categories_from_labels", "pr_curve", "ranked_experiments", "model_selection",
    "split_refined", "coverage_gaps_forced", "coverage_moves", "coverage_repaired", "frozen_manifest",
    "match_components", "frozen_split_stats", "frozen_digest", "ended_sessions_stream", "ended_violations_stream", "manifest_changes",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(repr(row[i]) for i in order) for row in rows])


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    found = registry.queries()[name](spark, sf_dir)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert canonical(found.columns, found.collect()) == canonical(columns, cursor.fetchall())


def test_every_query_has_sql():
    own = set(registry.queries()) - set(registry.CORPUS_QUERIES)
    assert own <= set(registry.oracle_sql())


def test_entry(spark):
    assert registry.entry(spark).count() == 1
