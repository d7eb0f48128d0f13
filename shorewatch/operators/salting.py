"""Joins of findings with one row per source, however large one source is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorewatch.operators.tables import written

#: Partitions that a source is spread over where the other side is too large to broadcast.
SALTS = 16
#: Bytes, as text, of rows that go to every executor; findings then stay where they are.
MAX_LIST_BYTES = 64 << 20


def salted_join(
    findings: DataFrame, lists: DataFrame, keys: list[str], salts: int = SALTS, how: str = "inner", max_bytes: int = MAX_LIST_BYTES
) -> DataFrame:
    """Findings joined by keys; files of a source go to ``salts`` partitions and the other side's rows to each of them.

    The lists are written and counted first: Spark's estimate before a run is that of the findings they were made of,
    and findings would be shuffled before it knows better.  Up to ``max_bytes`` they are broadcast, without salts.
    """
    lists = written(lists, "lists")
    size = lists.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    if size <= max_bytes:
        return findings.join(F.broadcast(lists), keys, how)
    spread = findings.withColumn("_salt", F.pmod(F.xxhash64("file"), F.lit(salts)).cast("int"))
    copies = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # By the bytes of the compressed table Spark would take the copies for small and collect them all in the driver.
    return spread.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")
