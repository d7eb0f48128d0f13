from pyspark.sql import functions as F

from contract.registry import Context
from shorewatch.operators.diff import compare, new_findings
from shorewatch.operators.scan import scan
from shorewatch.sources.rules import RulePack
from shorewatch.streaming.incremental import file_stream, finding_stream, publish, run_available, scan_versioned, unseen

SF = "/root/testdata/sf0.001"


def arrivals(c, where):
    """Files of the planted corpus with a scan time taken from the events table."""
    first = c.table("events").agg(F.min("ts").alias("t")).first().t
    return c.corpus.where(where).withColumn("scanned_at", F.lit(first).cast("timestamp"))


def key(frame):
    return sorted(map(tuple, frame.select("source", "file", "rule_id", "line", "status").collect()))


def test_stream_equals_batch(spark, tmp_path):
    c = Context(spark, SF)
    inbox = str(tmp_path / "inbox")
    arrivals(c, F.col("file").like("src/%")).coalesce(2).write.parquet(inbox)
    stream = finding_stream(file_stream(spark, inbox), c.pack, c.as_of, c.exemptions)
    run_available(stream, str(tmp_path / "out")).awaitTermination()
    first = key(spark.read.parquet(str(tmp_path / "out")))
    arrivals(c, F.col("file").like("a/%")).coalesce(1).write.mode("append").parquet(inbox)
    run_available(stream, str(tmp_path / "out")).awaitTermination()
    both = key(spark.read.parquet(str(tmp_path / "out")))
    expected = key(scan(c.corpus.where("file like 'src/%' or file like 'a/%'"), c.pack, c.as_of, c.exemptions))
    assert 0 < len(first) < len(both)
    assert both == expected


def test_unseen_fingerprints(spark, tmp_path):
    c = Context(spark, SF)
    inbox = str(tmp_path / "inbox")
    rows = arrivals(c, F.col("file").like("a/b/%"))
    rows.unionAll(rows).coalesce(2).write.parquet(inbox)
    stream = unseen(finding_stream(file_stream(spark, inbox), c.pack, c.as_of))
    run_available(stream, str(tmp_path / "out")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = scan(c.corpus.where("file like 'a/b/%'"), c.pack, c.as_of)
    counts = compare(out, batch).groupBy("change").count().collect()
    assert [(r.change) for r in counts] == ["unchanged"]
    assert out.count() == counts[0]["count"]
    assert new_findings(batch, out).count() == 0


def test_a_batch_that_runs_again_keeps_its_version(spark, tmp_path):
    """Newer rules are published between a batch and its repetition; the repetition leaves the same rows."""
    c = Context(spark, SF)
    inbox, tables, out, checkpoint = (str(tmp_path / n) for n in ("inbox", "tables", "out", "checkpoint"))
    arrivals(c, F.col("file").like("a/%")).coalesce(2).write.parquet(inbox)
    publish(tables, 0, RulePack(c.pack.rules[:12]), c.exemptions.limit(0))
    run = lambda: scan_versioned(file_stream(spark, inbox), tables, out, checkpoint, c.as_of).awaitTermination()
    run()
    first = key(spark.read.parquet(f"{out}/findings"))
    publish(tables, 1, c.pack, c.exemptions)
    # As after a failure between the batch and its entry in the log of commits.
    for name in ("0", ".0.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    run()
    again = spark.read.parquet(f"{out}/findings")
    assert key(again) == first and {r.version for r in again.select("version").distinct().collect()} == {0}
    arrivals(c, F.col("file").like("src/%")).coalesce(1).write.mode("append").parquet(inbox)
    run()
    later = spark.read.parquet(f"{out}/findings").where("version = 1")
    assert key(later) == key(scan(c.corpus.where("file like 'src/%'"), c.pack, c.as_of, c.exemptions))
    assert first and later.count() > 0
