"""Path and file-name rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolytics import settings

_SUFFIX = r"(?<=[^/])\.[^./]+$"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_name(path: Column) -> Column:
    """The folder of a file."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(file_name(path)) - 1)


def plain_path(path: Column) -> Column:
    """Drop the `file:` scheme that Spark adds to local paths."""
    return F.regexp_replace(path, "^file:/*", "/")


def normal_path(path: Column) -> Column:
    """An absolute path without `.`, `..` and empty components; scheme and authority stay."""
    head = F.regexp_extract(path, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", 0)
    parts = F.split(F.substring(path, F.length(head) + 1, F.length(path)), "/")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part.isin("", "."), done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(head, F.lit("/"), F.array_join(kept, "/"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), _SUFFIX, "")


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(file_name(path), _SUFFIX, 0))


def with_suffix(path: Column, new: str) -> Column:
    return F.concat(F.regexp_replace(path, _SUFFIX, ""), F.lit(new))


def has_image_suffix(path: Column) -> Column:
    return suffix(path).isin(*settings.IMAGE_EXTENSIONS)


def media_type(path: Column) -> Column:
    """`image`, `video`, or null for anything else."""
    found = suffix(path)
    return F.when(found.isin(*settings.PHOTO_SUFFIXES), "image").when(
        found.isin(*settings.VIDEO_SUFFIXES), "video"
    )


def label_path(path: Column, root: str) -> Column:
    """Where the label file of an image lives: the last `images` component (any case) becomes
    `labels`; without one, the path below `root` is mirrored under `root/labels`."""
    root = root.rstrip("/")
    parts = F.split(path, "/")
    from_end = F.array_position(F.reverse(F.transform(parts, F.lower)), "images").cast("int")
    before = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - from_end, F.lit(0)))
    after = F.slice(parts, -F.greatest(from_end - 1, F.lit(1)), F.greatest(from_end - 1, F.lit(0)))
    swapped = F.array_join(F.concat(before, F.array(F.lit("labels")), after), "/")
    below = F.when(
        F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 2**31 - 1)
    ).otherwise(file_name(path))
    mirrored = F.concat(F.lit(root + "/labels/"), below)
    return with_suffix(F.when(from_end > 0, swapped).otherwise(mirrored), ".txt")


def relative_path(path: Column, sources: Sequence[str]) -> Column:
    """Path below the first source folder that contains it, else the file name."""
    inside = [
        F.when(
            F.startswith(path, F.lit(source.rstrip("/") + "/")),
            F.substring(path, len(source.rstrip("/")) + 2, 2**31 - 1),
        )
        for source in sources
    ]
    return F.coalesce(*inside, file_name(path))


def source_key(path: Column) -> Column:
    """The original an exported variant came from: the name before `.rf.`, else the stem."""
    name = file_name(path)
    return F.when(F.contains(name, F.lit(".rf.")), F.substring_index(name, ".rf.", 1)).otherwise(
        file_stem(path)
    )
