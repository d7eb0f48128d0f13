"""Target lists of bulk scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shorewatch import model
from shorewatch.sources.rules import table
from shorewatch.sources.trees import FAILFAST, parsed_files, yaml_or_json


def parse_targets(document: str) -> list[dict]:
    loaded = yaml_or_json(document) or {}
    targets = loaded.get("targets") if isinstance(loaded, dict) else None
    if not isinstance(targets or [], list) or not all(isinstance(t, dict) for t in targets or []):
        raise ValueError("unreadable: targets is no list of mappings")
    return [{f.name: str(t.get(f.name) or "") for f in model.TARGETS.fields} for t in targets or []]


def targets_from_yaml(spark: SparkSession, *paths: str, mode: str = FAILFAST) -> DataFrame:
    """Targets of all files, read in the tasks."""
    files = table(spark, [{"key": p, "path": p} for p in paths], "key string, path string")
    columns = ", ".join(f"{f.name} string" for f in model.TARGETS.fields)
    return parsed_files(files, lambda text, _: parse_targets(text), columns, mode).drop("key", "problem")
