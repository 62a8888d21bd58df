"""The dataset specification file and the sources it names."""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from annolytics import settings
from annolytics.operators.validate import ISSUE_COLUMNS
from annolytics.taxonomy import Taxonomy

try:
    import yaml
except ImportError:  # JSON specifications still work
    yaml = None


@dataclass(frozen=True)
class DatasetSpec:
    """Root folder, classes and the source paths of each split (empty when the split is undefined)."""

    path: str
    root: str
    taxonomy: Taxonomy
    sources: dict[str, tuple[str, ...]]

    def require_all_splits(self) -> DatasetSpec:
        for split, found in self.sources.items():
            if not found:
                names = " or ".join(repr(alias) for alias in settings.SPLIT_ALIASES[split])
                raise ValueError(f"the specification must define {names}")
        return self

    def classes(self, spark: SparkSession) -> DataFrame:
        return self.taxonomy.table(spark)

    def split_sources(self, spark: SparkSession) -> DataFrame:
        rows = [(split, source) for split, found in self.sources.items() for source in found]
        return spark.createDataFrame(rows, "split string, source string")


def read_spec(spark: SparkSession, path: str) -> DatasetSpec:
    """Read a YAML or JSON specification: `names`, optional `path`, and train / val / test, each one
    source or a list.  `validation` is accepted for `val`."""
    text = "\n".join(row.value for row in spark.read.text(path, wholetext=True).collect())
    if path.endswith(".json"):
        content = json.loads(text)
    elif yaml is None:
        raise RuntimeError("PyYAML is not installed: use a JSON specification")
    else:
        try:
            content = yaml.safe_load(text)
        except yaml.YAMLError as error:
            raise ValueError(f"invalid YAML in {path}: {error}") from error
    if not isinstance(content, dict):
        raise ValueError(f"the specification must be a mapping: {path}")

    taxonomy = Taxonomy.of(content.get("names"))
    folder = posixpath.dirname(path)
    declared = content.get("path")
    root = folder if declared in (None, "") else _resolve(str(declared), folder)
    sources: dict[str, tuple[str, ...]] = {}
    for split, aliases in settings.SPLIT_ALIASES.items():
        value = next((content[alias] for alias in aliases if alias in content), None)
        values = value if isinstance(value, list) else [value]
        sources[split] = tuple(_resolve(str(v), root) for v in values if v not in (None, ""))
    return DatasetSpec(path, root, taxonomy, sources)


def spec_text(taxonomy: Taxonomy, sources: dict[str, str], origin: str) -> str:
    """A specification of a dataset folder, in block YAML; strings are quoted as in JSON."""
    lines = ["path: .", *(f"{split}: {json.dumps(source)}" for split, source in sources.items())]
    lines += [f"nc: {len(taxonomy.ids)}", "names:"]
    lines += [f"  {i}: {json.dumps(name, ensure_ascii=False)}" for i, name in taxonomy.names.items()]
    return "\n".join([*lines, "source:", f"  folder: {json.dumps(origin, ensure_ascii=False)}"]) + "\n"


def _resolve(path: str, base: str) -> str:
    if path.startswith("/") or "://" in path:
        return posixpath.normpath(path) if path.startswith("/") else path.rstrip("/")
    scheme, separator, rest = base.partition("://")
    if separator:
        return f"{scheme}://{posixpath.normpath(posixpath.join(rest, path))}"
    return posixpath.normpath(posixpath.join(base, path))


def issue_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Issues found on the driver while resolving the few sources of a specification."""
    schema = ", ".join(f"{c} {'int' if c == 'line' else 'string'}" for c in ISSUE_COLUMNS)
    return spark.createDataFrame(rows, schema)
