"""Streams run to their end over deliveries of the planted corpus."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contract import oracle_base as O
from contract.registry import Context, query
from shorewatch.operators.tables import shared_directory
from shorewatch.sources.rules import RulePack
from shorewatch.streaming import incremental
from shorewatch.streaming.changes import STATE_STORE, changes

#: A file's order number, which tells its delivery.
_ORDER_SQL = r"CAST(regexp_extract(file, 'F(\d+)_', 1) AS BIGINT) % 3"
_LATER_RULE = "team-sha256"


@query(
    "t1_incremental_scan",
    O.from_findings(
        f"""SELECT source, file, rule_id, CAST(line AS BIGINT) AS line, status, CAST(0 AS BIGINT) AS version FROM inline_findings
            WHERE {_ORDER_SQL} = 0 AND rule_id <> '{_LATER_RULE}'
            UNION ALL SELECT source, file, rule_id, CAST(line AS BIGINT), status, 1 FROM findings WHERE {_ORDER_SQL} <> 0"""
    ),
)
def t1_incremental_scan(c: Context) -> DataFrame:
    """Three deliveries; after the first the rules and exemptions change, and each run goes on from the checkpoint."""
    root = shared_directory(c.spark, f"stream-{uuid4().hex}")
    order = F.regexp_extract("file", r"F(\d+)_", 1).cast("bigint") % 3
    none = c.exemptions.limit(0)
    earlier = RulePack(r for r in c.pack.rules if r["id"] != _LATER_RULE)
    for delivery in range(3):
        if delivery < 2:
            pack, exemptions = ((earlier, none), (c.pack, c.exemptions))[delivery]
            incremental.publish(f"{root}/tables", delivery, pack, exemptions)
        arrived = c.corpus.where(order == delivery).withColumn("scanned_at", c.as_of)
        arrived.write.mode("append").parquet(f"{root}/inbox")
        stream = incremental.file_stream(c.spark, f"{root}/inbox")
        run = incremental.scan_versioned(stream, f"{root}/tables", f"{root}/out", f"{root}/checkpoint", c.as_of)
        run.awaitTermination()
    found = c.spark.read.parquet(f"{root}/out/findings")
    return found.select("source", "file", "rule_id", F.col("line").cast("bigint"), "status", F.col("version").cast("bigint"))


_LATE, _HORIZON = "2 days", 5 * 86_400_000
_SIGHTINGS_SQL = """sightings AS (
  SELECT 'org' || CAST(user_id % 7 AS VARCHAR) AS source, event_type || '-' || CAST(event_id % 40 AS VARCHAR) AS fingerprint,
         date_trunc('second', ts) AS seen_at FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)"""


@query(
    "t2_finding_changes",
    f"""WITH {_SIGHTINGS_SQL}, marked AS (
      SELECT *, CASE WHEN seen_at <= lag(seen_at) OVER w + INTERVAL 5 DAY THEN 0 ELSE 1 END AS begins FROM sightings
      WINDOW w AS (PARTITION BY source, fingerprint ORDER BY seen_at)
    ), numbered AS (
      SELECT *, sum(begins) OVER (PARTITION BY source, fingerprint ORDER BY seen_at ROWS UNBOUNDED PRECEDING) AS stretch FROM marked
    ), stretches AS (
      SELECT source, fingerprint, stretch, min(seen_at) AS first, max(seen_at) AS last, count(*) AS n FROM numbered GROUP BY ALL
    ), passed AS (SELECT max(seen_at) - INTERVAL 2 DAY AS at FROM sightings)
    SELECT source, fingerprint, 'new' AS change, epoch_ms(first) AS at_ms, CAST(NULL AS BIGINT) AS sightings
    FROM stretches, passed WHERE first < passed.at
    UNION ALL SELECT source, fingerprint, 'fixed', epoch_ms(last), n FROM stretches, passed WHERE last + INTERVAL 5 DAY < passed.at""",
)
def t2_finding_changes(c: Context) -> DataFrame:
    """Sightings in three deliveries, a tenth of each one's last day and a half coming with the next."""
    root = shared_directory(c.spark, f"changes-{uuid4().hex}")
    seen = (
        c.table("events")
        .where("ts IS NOT NULL AND user_id IS NOT NULL")
        .select(
            F.concat(F.lit("org"), (F.col("user_id") % 7).cast("string")).alias("source"),
            F.concat_ws("-", "event_type", (F.col("event_id") % 40).cast("string")).alias("fingerprint"),
            F.date_trunc("second", F.col("ts").cast("timestamp")).alias("seen_at"),
            (F.col("event_id") % 10 == 3).alias("slow"),
        )
    )
    low, high = seen.agg(F.min(F.unix_seconds("seen_at")), F.max(F.unix_seconds("seen_at"))).first()
    second = F.unix_seconds("seen_at")
    # Slow rows are a day and a half behind; the last delivery takes all that is left.
    arrival = F.least(F.floor((second + F.when(F.col("slow"), 129_600).otherwise(0) - low) * 3 / (high - low + 1)), F.lit(2))
    before = {k: c.spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        c.spark.conf.set(k, v)
    try:
        for delivery in range(3):
            seen.where(arrival == delivery).drop("slow").write.mode("append").parquet(f"{root}/inbox")
            stream = c.spark.readStream.schema(seen.drop("slow").schema).parquet(f"{root}/inbox")
            found = changes(stream, _HORIZON, _LATE)
            incremental.run_available(found, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    finally:
        for k, v in before.items():
            c.spark.conf.unset(k) if v is None else c.spark.conf.set(k, v)
    out = c.spark.read.schema(found.schema).parquet(f"{root}/out")
    return out.select("source", "fingerprint", "change", F.unix_millis("at").alias("at_ms"), "sightings")
