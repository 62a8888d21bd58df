"""Datasets as plain folders: one file a row, written by the tasks."""

import hashlib
import json
import threading

import pytest

from annolytics import settings
from annolytics.plans import dataset_jobs as jobs
from annolytics.sources import files
from annolytics.sources.publish import read_published
from datasets import folder_pair, write_image, write_spec

FOLDERS = {"train": "train/images", "val": "valid/images", "test": "test/images"}
SOURCE_CLASSES = sorted({*settings.CLASS_SYNONYMS, *settings.REMOVED_SOURCE_CLASSES})


def yard(tmp_path):
    """Two dozen sites under the source taxonomy, with labels beside the images."""
    root = tmp_path / "yard+ü"
    names = ["Human", "hat", "vest", "gloves", "boots", "glasses"]
    for site in range(24):
        ids = [SOURCE_CLASSES.index(n) for n in ("Human", "no hat", "no vest", names[site % 6])]
        folder_pair(root, ("train", "valid", "test")[site // 8], f"deck {site:02}", f"view {site}", ids)
    return root, write_spec(tmp_path / "data.json", root, SOURCE_CLASSES, **FOLDERS)


def plain(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and p.suffix != ".crc"}


def test_a_remap_becomes_a_folder_that_validates(spark, tmp_path):
    root, spec = yard(tmp_path)
    clean, out = str(tmp_path / "clean"), tmp_path / "out"
    jobs.remap_dataset(spark, spec, clean)
    report = jobs.export_dataset(spark, clean, str(out))
    found = plain(out)
    assert set(found) >= {"data.yaml", files.REPORT}
    images = {n: b for n, b in found.items() if n.endswith(".jpg")}
    labels = {n: b.decode() for n, b in found.items() if n.endswith(".txt")}
    assert len(images) == len(labels) == 24 and report["files"] == 48
    assert report["bytes"] == sum(map(len, images.values())) + sum(map(len, labels.values()))
    assert images["valid/images/deck 09.jpg"] == (root / "valid/images/deck 09.jpg").read_bytes()
    assert labels == {r["output_label"]: r["label_text"] for r in read_published(spark, clean, "labels").collect()}

    tables = jobs.validate_dataset(spark, str(out / "data.yaml"))
    assert tables["verdict"].first()["valid"] is True
    before = jobs.validate_dataset(spark, clean)
    for name in ("splits", "classes"):
        assert sorted(map(repr, tables[name].collect())) == sorted(map(repr, before[name].collect()))
    with pytest.raises(FileExistsError):
        jobs.export_dataset(spark, clean, str(out))
    with pytest.raises(ValueError, match="overlap"):
        jobs.export_dataset(spark, clean, clean + "/v=1/inside")


def test_a_freeze_becomes_a_folder_with_the_recorded_digests(spark, tmp_path):
    _, spec = yard(tmp_path)
    clean, final, out = str(tmp_path / "clean"), str(tmp_path / "final"), tmp_path / "out"
    jobs.remap_dataset(spark, spec, clean)
    jobs.freeze_dataset(spark, clean, final)
    jobs.export_dataset(spark, final, str(out))
    rows = read_published(spark, final, "manifest").collect()
    for row in rows:
        for name, digest in ((row["image"], row["image_sha256"]), (row["label"], row["label_sha256"])):
            assert hashlib.sha256((out / name).read_bytes()).hexdigest() == digest
    assert len(plain(out)) == 2 * len(rows) + 2
    again = str(tmp_path / "again")
    jobs.freeze_dataset(spark, str(out / "data.yaml"), again, classes=settings.FINAL_CLASSES, removed=())
    assert {r["image_sha256"] for r in read_published(spark, again, "manifest").collect()} == {
        r["image_sha256"] for r in rows
    }


def test_changed_bytes_fail_the_job_and_leave_no_folder(spark, tmp_path):
    root, spec = yard(tmp_path)
    clean, out = str(tmp_path / "clean"), tmp_path / "out"
    jobs.remap_dataset(spark, spec, clean)
    write_image(root / "test/images/deck 20.jpg", "painted over")
    with pytest.raises(Exception, match="bytes have changed"):
        jobs.export_dataset(spark, clean, str(out))
    assert not out.exists()


def sink_rows(spark, rows):
    return spark.createDataFrame(rows, "path string, content binary, source string, sha256 string")


def test_rows_of_the_sink(spark, tmp_path):
    big = tmp_path / "big.bin"
    big.write_bytes(bytes(range(256)) * 9_000)  # more than one chunk
    done = files.write_files(
        sink_rows(spark, [("a/b/c.txt", b"", None, None), ("d.bin", None, f"file:{big}", None), ("ü ?#%41.txt", b"x", None, None)]),
        str(tmp_path / "out"),
    )
    assert plain(tmp_path / "out") == {
        "a/b/c.txt": b"", "d.bin": big.read_bytes(), "ü ?#%41.txt": b"x",
        files.REPORT: json.dumps(done).encode(),
    }
    assert (done["files"], done["bytes"]) == (3, 256 * 9_000 + 1)
    none = files.write_files(sink_rows(spark, []), str(tmp_path / "none"))
    assert (none["files"], none["bytes"]) == (0, 0)


def test_the_sink_refuses_what_it_cannot_write(spark, tmp_path):
    with pytest.raises(ValueError, match="several rows"):
        files.write_files(sink_rows(spark, [("a", b"1", None, None), ("a", b"2", None, None)]), str(tmp_path / "twice"))
    with pytest.raises(Exception, match="leaves the folder"):
        files.write_files(sink_rows(spark, [("../a", b"1", None, None)]), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() and not (tmp_path / "a").exists()


def test_a_task_that_runs_twice_changes_nothing(tmp_path):
    from pyspark.sql import Row

    rows = [Row(path=f"x/{i}.txt", content=b"%d" % i, source=None, sha256=None) for i in range(5)]
    writer = files.FileWriter(str(tmp_path / "out"))
    first, second = writer.write(iter(rows)), writer.write(iter(rows))
    assert first == second == files.Written(5, 5)
    writer.commit([second, None])
    assert len(plain(tmp_path / "out")) == 6
    writer.abort([second])
    assert not (tmp_path / "out").exists()


def test_an_aborted_folder_stays_away(tmp_path):
    """A task that is being killed writes once more after the folder is gone."""
    out = tmp_path / "out"
    (out / "a").mkdir(parents=True)
    late = threading.Timer(0.4, lambda: (out / "b").mkdir(parents=True))
    late.start()
    files.FileWriter(str(out)).abort([])
    late.join()
    assert not out.exists()
