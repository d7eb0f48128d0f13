"""Configured exemptions: one ordered list per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorewatch import model
from shorewatch import values as V
from shorewatch.sources.rules import table
from shorewatch.sources.trees import PERMISSIVE, below, parsed_files, yaml_or_json

FIELDS = ("rule", "path", "reason", "owner", "until")


def parse_exemptions(document: str) -> list[dict]:
    """Entries of one configuration file; ValueError where it can't be read as such."""
    loaded = yaml_or_json(document) or {}
    entries = loaded.get("exemptions") if isinstance(loaded, dict) else None
    if not isinstance(entries or [], list) or not all(isinstance(e, dict) for e in entries or []):
        raise ValueError("unreadable: exemptions is no list of mappings")
    text = lambda value: "" if value is None else str(value)
    return [{"ord": i, **{f: text(e.get(f)) for f in FIELDS}} for i, e in enumerate(entries or [])]


def exemptions_from_checkouts(spark: SparkSession, roots: dict[str, str] | DataFrame, mode: str = PERMISSIVE) -> DataFrame:
    """Lists of all checkouts, read in the tasks; ``roots`` maps source to folder, or is a table (source, root).

    No file means no entries.  A broken file is one entry without reason, which voids the list of its own source
    only and names the problem as its owner; see :func:`shorewatch.sources.trees.parsed_files` for other modes.
    Validity (every entry needs a reason) is decided where the lists are applied.
    """
    if isinstance(roots, dict):
        roots = table(spark, [{"source": s, "root": r} for s, r in roots.items()], "source string, root string")
    paths = roots.select(F.col("source").alias("key"), below(F.col("root"), V.CONFIG_FILE).alias("path"))
    columns = ", ".join(f"{f} string" for f in FIELDS)
    read = parsed_files(paths, lambda text, _: parse_exemptions(text), f"ord int, {columns}", mode)
    blank = {f: F.coalesce(f, F.when(F.lit(f == "owner"), F.col("problem")), F.lit("")) for f in FIELDS}
    read = read.withColumns(blank | {"ord": F.coalesce("ord", F.lit(0))})
    return read.withColumnRenamed("key", "source").select(*[f.name for f in model.CONFIG_EXEMPTIONS.fields])
