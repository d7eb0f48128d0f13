"""Rule files on shared storage as a rule table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorewatch import model
from shorewatch.sources.rules import FIELDS, RuleError, listed_rules
from shorewatch.sources.trees import FAILFAST, list_files, parsed_files

_COLUMNS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in model.LAYERED_RULES.fields if f.name not in ("layer", "file"))


def _rules(text: str, _: str) -> Iterator[dict]:
    try:
        return ({"pos": n, **{f: rule[f] for f in FIELDS}} for n, rule in enumerate(listed_rules(text)))
    except RuleError:
        raise
    except Exception as error:
        raise ValueError(f"unreadable: {error}") from error


def rules_from_folders(spark: SparkSession, *folders: str, mode: str = FAILFAST) -> DataFrame:
    """(layer, file, pos, rule fields, problem) of all ``*.yaml`` and ``*.yml`` files below the folders, one layer each.

    Files are listed and read in the tasks; rules are not validated here, see
    :func:`shorewatch.operators.rules.check_rules` and :func:`shorewatch.operators.rules.merge_layers`.
    """
    layers = []
    for n, folder in enumerate(folders):
        files = list_files(spark, folder).where(F.col("file").rlike(r"\.ya?ml\z"))
        read = parsed_files(files.select(F.col("file").alias("key"), "path"), _rules, _COLUMNS, mode)
        layers.append(read.withColumnRenamed("key", "file").withColumn("layer", F.lit(n)))
    columns = [*[f.name for f in model.LAYERED_RULES.fields], "problem"]
    return reduce(DataFrame.unionByName, layers).select(*columns)
