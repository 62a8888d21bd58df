"""Display names and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.functions.paths import file_stem


def class_colour(class_id: Column) -> Column:
    """A stable `#rrggbb` per class id: hues a golden-ratio step apart at fixed saturation."""
    saturation, value = settings.COLOUR_SATURATION, settings.COLOUR_VALUE
    hue = F.pmod(class_id.cast("double") * settings.HUE_STEP, F.lit(1.0))
    sextant = F.floor(hue * 6.0).cast("int")
    part = hue * 6.0 - sextant
    low = F.lit(value * (1.0 - saturation))
    falling = value * (1.0 - saturation * part)
    rising = value * (1.0 - saturation * (1.0 - part))
    top = F.lit(value)
    wheel = {
        0: (top, rising, low),
        1: (falling, top, low),
        2: (low, top, rising),
        3: (low, falling, top),
        4: (rising, low, top),
        5: (top, low, falling),
    }
    channels = []
    for channel in range(3):
        picked = F.when(sextant % 6 == 0, wheel[0][channel])
        for step in range(1, 6):
            picked = picked.when(sextant % 6 == step, wheel[step][channel])
        level = F.rint(picked * 255).cast("int")
        channels.append(F.lower(F.lpad(F.hex(level), 2, "0")))
    return F.concat(F.lit("#"), *channels)


def preview_name(index: Column, path: Column) -> Column:
    """Safe, collision-free output name of a sampled image."""
    cleaned = F.regexp_replace(file_stem(path), r"[^A-Za-z0-9._-]+", "_")
    cleaned = F.regexp_replace(cleaned, r"^[._]+|[._]+$", "")
    stem = F.when(cleaned == "", "image").otherwise(cleaned)
    number = index.cast("string")
    padded = F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))
    digest = F.substring(F.sha2(path, 256), 1, 8)
    return F.concat(F.lit("sample_"), padded, F.lit("_"), stem, F.lit("_"), digest, F.lit(".png"))


def experiment_label(model: Column, imgsz: Column, epochs: Column) -> Column:
    return F.concat_ws(
        " / ",
        file_stem(model),
        F.concat(imgsz.cast("string"), F.lit("px")),
        F.concat(epochs.cast("string"), F.lit("ep")),
    )
