"""Incremental scans.

The scan and the exemption lookup are narrow per file, so the batch functions are
used unchanged on a stream of new file rows.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shorewatch import model
from shorewatch.operators.listings import with_fingerprint
from shorewatch.operators.scan import scan
from shorewatch.sources.rules import RulePack


def file_stream(spark: SparkSession, directory: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Stream of file rows with their arrival time ``scanned_at``."""
    schema = model._fields(*[(f.name, f.dataType) for f in model.FILES.fields], ("scanned_at", model.T.TimestampType()))
    return spark.readStream.schema(schema).format(fmt).options(**options).load(directory)


def finding_stream(
    files: DataFrame, pack: RulePack, as_of: Column | None = None, exemptions: DataFrame | None = None
) -> DataFrame:
    """Findings of every new file row; equal to the batch scan of the same rows."""
    return scan(files, pack, as_of, exemptions)


def unseen(findings: DataFrame, horizon: str = "30 days") -> DataFrame:
    """First occurrence of each fingerprint within the watermark horizon."""
    return (
        with_fingerprint(findings)
        .withWatermark("scanned_at", horizon)
        .dropDuplicatesWithinWatermark(["source", "fingerprint"])
    )


def run_available(
    stream: DataFrame, output: str, checkpoint: str | None = None, fmt: str = "parquet"
) -> StreamingQuery:
    """Process everything that has arrived and stop.

    Progress is kept below the folder the session names in ``spark.checkpoint.dir``
    unless a location is given.
    """
    if checkpoint is None:
        base = stream.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            raise ValueError("set spark.checkpoint.dir or pass a checkpoint location")
        checkpoint = f"{base.rstrip('/')}/{hashlib.sha256(output.encode()).hexdigest()[:16]}"
    return (
        stream.writeStream.format(fmt)
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def publish(directory: str, version: int, pack: RulePack, exemptions: DataFrame) -> None:
    """A new version of the rule and exemption tables that later batches scan with."""
    pack.frame(exemptions.sparkSession).write.mode("overwrite").parquet(f"{directory}/rules/version={version}")
    exemptions.write.mode("overwrite").parquet(f"{directory}/exemptions/version={version}")


def _version_of(spark: SparkSession, directory: str, output: str, batch: int) -> int:
    """The version a batch is scanned with: the latest when it began first, also when it is begun again."""
    choices = f"{output}/_choices/batch={batch}"
    try:
        return spark.read.schema("version int").parquet(choices).first()["version"]
    except AnalysisException:
        version = spark.read.parquet(f"{directory}/exemptions").agg(F.max("version").alias("v")).first()["v"]
        rules = spark.read.parquet(f"{directory}/rules").agg(F.max("version").alias("v")).first()["v"]
        # An empty exemption table has no rows to tell its version by.
        version = max(v for v in (version, rules) if v is not None)
        spark.createDataFrame([(int(version),)], "version int").write.mode("overwrite").parquet(choices)
        return int(version)


def scan_versioned(files: DataFrame, directory: str, output: str, checkpoint: str, as_of: Column | None = None) -> StreamingQuery:
    """Scan what has arrived with the published version of the rules and exemptions, and stop.

    Every micro-batch is a batch scan of its own, so exemption lists of any size and rules that change between batches
    work as in a batch job.  Its findings, with the ``version`` they were made with, replace the folder of its number;
    a batch that is run again after a failure takes the version it had and leaves the same rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = _version_of(spark, directory, output, number)
        rules = spark.read.schema(model.RULES).parquet(f"{directory}/rules/version={version}")
        exemptions = spark.read.schema(model.CONFIG_EXEMPTIONS).parquet(f"{directory}/exemptions/version={version}")
        found = scan(batch, RulePack.from_table(rules), as_of, exemptions).withColumn("version", F.lit(version))
        found.write.mode("overwrite").parquet(f"{output}/findings/batch={number}")

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
