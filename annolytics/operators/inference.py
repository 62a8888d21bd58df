"""Run an injected model or checker over image rows in bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Predict = Callable[[pd.DataFrame], pd.DataFrame]


def check_model_parameters(confidence: float, imgsz: int) -> None:
    """Bounds of what a detector is run with."""
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence must be between 0 and 1")
    if imgsz < 32:
        raise ValueError("input size must be at least 32 pixels")


def batched_inference(
    rows: DataFrame, make_predict: Callable[[], Predict], batch_size: int, schema: str | T.StructType
) -> DataFrame:
    """`make_predict()` runs once per task and returns a function from a frame of at most
    `batch_size` rows to a frame with exactly one result per row, in order.  Any other number of
    results fails the task."""
    if batch_size < 1:
        raise ValueError("batch size must be at least 1")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                batch = frame.iloc[start : start + batch_size].reset_index(drop=True)
                result = predict(batch)
                if len(result) != len(batch):
                    raise RuntimeError(
                        f"prediction returned {len(result)} results for a batch of {len(batch)} rows"
                    )
                yield result

    return rows.mapInPandas(run, schema)


def check_images(
    images: DataFrame, key: str, make_check: Callable[[], Callable[[pd.Series], pd.Series]], batch_size: int = 64
) -> DataFrame:
    """`key` and `image_readable` of every row (key, content), from a pluggable decoder: a function from a
    series of contents to a series of booleans.  Contents go to Python, but do not come back."""

    def make_predict() -> Predict:
        check = make_check()
        return lambda batch: pd.DataFrame({key: batch[key], "image_readable": check(batch["content"]).astype(bool)})

    schema = T.StructType([images.schema[key], T.StructField("image_readable", T.BooleanType())])
    return batched_inference(images.select(key, "content"), make_predict, batch_size, schema)
