"""The class table of a dataset: a small, driver-side specification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Taxonomy:
    """Class ids and names, in id order."""

    names: dict[int, str]

    @staticmethod
    def of(names: Sequence[str] | Mapping[object, object]) -> Taxonomy:
        if isinstance(names, Mapping):
            try:
                table = {int(key): str(value) for key, value in names.items()}
            except (TypeError, ValueError) as error:
                raise ValueError("class ids must be integers") from error
        elif isinstance(names, Sequence) and not isinstance(names, str):
            table = {index: str(name) for index, name in enumerate(names)}
        else:
            raise ValueError("class names must be a list or an id-to-name mapping")
        if not table:
            raise ValueError("at least one class is needed")
        if min(table) < 0:
            raise ValueError("class ids cannot be negative")
        return Taxonomy(dict(sorted(table.items())))

    @property
    def ids(self) -> list[int]:
        return list(self.names)

    def id_of(self, name: str) -> int:
        return next(key for key, value in self.names.items() if value == name)

    def name_of(self, class_id: Column) -> Column:
        """Name of an id column; null when the id is not declared."""
        return self._lookup()[class_id.cast("string")]

    def _lookup(self) -> Column:
        pairs = [F.lit(part) for key, name in self.names.items() for part in (str(key), name)]
        return F.create_map(*pairs)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.names.items()), "class_id long, class_name string")
