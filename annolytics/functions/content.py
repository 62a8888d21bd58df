"""Digests and signatures of file contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolytics import settings

_SHA2_BITS = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}


def digest(content: Column, algorithm: str = "sha256") -> Column:
    if algorithm in _SHA2_BITS:
        return F.sha2(content, _SHA2_BITS[algorithm])
    if algorithm == "sha1":
        return F.sha1(content)
    if algorithm == "md5":
        return F.md5(content)
    raise ValueError(f"unsupported hash algorithm: {algorithm}")


def looks_like_image(content: Column) -> Column:
    """Whether the leading bytes are those of a supported raster format.  This is a signature test;
    a full decoder can be plugged in with `operators.inference.check_images`."""
    head = F.hex(F.substring(content, 1, 12))
    known = head.rlike(settings.WEBP_SIGNATURE)
    for signature in settings.IMAGE_SIGNATURES:
        known = known | F.startswith(head, F.lit(signature))
    return F.coalesce(known, F.lit(False))


def utf8_text(content: Column) -> Column:
    """File bytes as text; null when they are not valid UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


# --- sizes from header bytes ----------------------------------------------------------------------


def _number(content: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """Unsigned number of `size` bytes, from byte `at` (the first is 1); null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    parts = [F.hex(F.substring(content, at + i, F.lit(1))) for i in range(size)]
    text = F.concat(*(reversed(parts) if little else parts))
    return F.when(F.length(text) == 2 * size, F.conv(text, 16, 10).cast("bigint"))


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.try_cast("int").alias("width"), height.try_cast("int").alias("height"))


def _bound(value: Column, use) -> Column:
    """`use(value)`, with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _jpeg_walk(content: Column) -> Column:
    """The segments, each skipped by its length, up to the frame header: (at, width, height).

    `at` is null when the walk has ended.  It goes on in stretches, each twice as long as the one before, up
    to the end of the bytes; stretches after its end have no steps.
    """

    def after_marker(state: Column, marker: Column) -> Column:
        at = state["at"]
        frame = marker.rlike("^FFC[0-35-79-BD-F]$")
        after = (
            F.when(frame | ~F.startswith(marker, F.lit("FF")) | marker.isin("FFDA", "FFD9"), None)
            .when(marker == "FFFF", at + 1)
            .when(marker.rlike("^FF(01|D[0-8])$"), at + 2)
            .otherwise(at + 2 + _number(content, (at + 2).try_cast("int"), 2))
        )
        return F.struct(
            after.alias("at"),
            F.when(frame, _number(content, (at + 7).try_cast("int"), 2)).otherwise(state["width"]).alias("width"),
            F.when(frame, _number(content, (at + 5).try_cast("int"), 2)).otherwise(state["height"]).alias("height"),
        )

    def step(state: Column, _: Column) -> Column:
        marker = F.hex(F.substring(content, state["at"].try_cast("int"), F.lit(2)))
        walked = _bound(marker, lambda found: after_marker(state, found))
        return F.when(state["at"].isNull(), state).otherwise(walked)

    def stretch(state: Column, steps: Column) -> Column:
        some = F.when(state["at"].isNotNull(), F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(some, state, step)

    none = F.lit(None).cast("bigint")
    start = F.struct(F.lit(3).cast("bigint").alias("at"), none.alias("width"), none.alias("height"))
    # stretches of 16, 32, ... steps; a segment has two bytes or more
    last = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.octet_length(content), F.lit(1)) / 32)).cast("int"))
    lengths = F.transform(F.sequence(F.lit(0), last), lambda k: F.pow(F.lit(2), k + 4).cast("int"))
    return F.aggregate(lengths, start, stretch)


def image_size(content: Column) -> Column:
    """Struct (width, height) in pixels from the header of PNG, JPEG, BMP and WebP bytes, null for others.

    PNG, BMP and WebP have their sizes at fixed places.  A JPEG is walked from segment to segment, as far as
    it goes.
    """
    head = F.hex(F.substring(content, 1, 30))
    jpeg = _jpeg_walk(content)
    lossless, tall = _number(content, 22, 4, little=True), _number(content, 23, 4, little=True)
    return (
        F.when(
            F.startswith(head, F.lit("89504E470D0A1A0A")) & (F.substring(head, 25, 8) == "49484452"),
            _size(_number(content, 17, 4), _number(content, 21, 4)),
        )
        .when(F.startswith(head, F.lit("FFD8FF")), F.transform(F.array(jpeg), lambda j: _size(j["width"], j["height"]))[0])
        .when(
            F.startswith(head, F.lit("424D")),
            # a negative height counts rows from the top
            _size(_number(content, 19, 4, True), F.least(tall, F.lit(1 << 32) - tall)),
        )
        .when(
            head.rlike("^52494646.{8}5745425056503858"),
            _size(_number(content, 25, 3, True) + 1, _number(content, 28, 3, True) + 1),
        )
        .when(
            head.rlike("^52494646.{8}574542505650384C"),
            _size(lossless.bitwiseAND(16383) + 1, F.shiftright(lossless, 14).bitwiseAND(16383) + 1),
        )
        .when(
            head.rlike("^52494646.{8}5745425056503820"),
            _size(
                _number(content, 27, 2, True).bitwiseAND(16383), _number(content, 29, 2, True).bitwiseAND(16383)
            ),
        )
    )
