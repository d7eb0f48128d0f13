"""Operators on rule tables (packs kept as tables rather than files)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorewatch import values as V
from shorewatch.functions import severity as sev

# Built-in extensions as a small lookup for tables.
_BUILT_IN = list(V.EXTENSIONS)


def _compiles():
    """Whether patterns compile: in the linear engine that rule packs are written for, and in the dialect's translation."""

    def compiles(patterns):
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        from shorewatch.functions.dialect import PatternError, to_java

        def one(pattern):
            try:
                to_java(pattern)
                pc.match_substring_regex(pa.array([""]), pattern)
            except (PatternError, pa.ArrowInvalid):
                return False
            return True

        known = {p: one(p) for p in set(patterns.dropna())}
        return pd.Series([known.get(p, False) for p in patterns], dtype=bool)

    return F.pandas_udf(compiles, "boolean", F.PandasUDFType.SCALAR)


def check_rules(rules: DataFrame) -> DataFrame:
    """One verdict per rule: what the loader refuses and what it merely tolerates.

    Patterns are compiled in the tasks, each distinct one of a batch once.
    """
    refused = F.when(~_compiles()("pattern"), "invalid pattern")
    required = [
        F.when(F.coalesce(F.col(name), F.lit("")) == "", f"{name} is required").when(
            ~F.col(name).isin(allowed), f"invalid {name}"
        )
        for name, allowed in (("quantum_threat", V.THREATS), ("primitive", V.PRIMITIVES))
    ]
    severity = F.coalesce(F.col("severity"), F.lit(""))
    return rules.withColumns(
        {
            "error": F.coalesce(refused, *required),
            "missing_id": F.coalesce(F.col("id"), F.lit("")) == "",
            "unlisted_severity": (severity != "") & ~severity.isin(V.SEVERITIES),
        }
    )


def resolve_severity(rules: DataFrame) -> DataFrame:
    return rules.withColumn(
        "severity",
        sev.effective(F.col("severity"), F.col("quantum_threat"), F.col("primitive")),
    )


def merge_layers(layered: DataFrame) -> DataFrame:
    """Union of rule layers: the last definition of an id wins, the first one sets its place.

    ``(layer, file, pos)`` of the result is the place, so sorting by it gives the
    evaluation order.  Grouping by id pre-aggregates before the shuffle.
    """
    place = F.struct("layer", "file", "pos")
    body = F.struct(*[c for c in layered.columns if c not in ("layer", "file", "pos", "id")])
    merged = layered.groupBy("id").agg(F.min(place).alias("first"), F.max_by(body, place).alias("body"))
    return merged.select("first.*", "id", "body.*")


def extension_table(rules: DataFrame) -> DataFrame:
    """Extension to language: declared extensions that are not built in, plus the built-in ones."""
    spark = rules.sparkSession
    declared = (
        rules.where(F.coalesce(F.col("language"), F.lit("")) != "")
        .select("ord", "language", F.posexplode("extensions").alias("pos", "ext"))
        .select("ord", "pos", "language", F.lower("ext").alias("ext"))
        .where(F.startswith("ext", F.lit(".")) & ~F.col("ext").isin(_BUILT_IN))
        .groupBy("ext")
        .agg(F.max_by("language", F.struct("ord", "pos")).alias("lang"))
    )
    pairs = F.map_from_arrays(
        F.array(*[F.lit(e) for e in V.EXTENSIONS]), F.array(*[F.lit(g) for g in V.EXTENSIONS.values()])
    )
    built_in = spark.range(1).select(F.explode(pairs).alias("ext", "lang"))
    return declared.unionByName(built_in)
