"""What the scan does once, and in how many tasks."""

from pyspark.sql import functions as F

from contract import planted as P
from shorewatch import model
from shorewatch.functions import exemptions as ex
from shorewatch.functions import text
from shorewatch.operators import listings
from shorewatch.operators.exemptions import apply_config
from shorewatch.sources.rules import table


def test_a_filter_on_the_status_looks_up_no_exemption_again(spark):
    entry = {"source": "s", "ord": 0, "rule": "", "path": "a/*", "reason": "r", "owner": "", "until": "2020-01-01"}
    found = [{"source": "s", "file": f, "rule_id": "r", "line": 1, "status": "active"} for f in ("a/x", "b/x")]
    as_of = F.lit("2026-04-19 12:00:00+00:00").cast("timestamp")
    listed = listings.active(apply_config(table(spark, found, model.FINDINGS), table(spark, [entry], model.CONFIG_EXEMPTIONS), as_of))
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(_list") == 1
    assert [r.file for r in listed.collect()] == ["b/x"]


def test_lines_above_where_no_line_is_blank(spark):
    spaces = ["", " ", "\t", "\x0b\x0c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\r"]
    texts = [*(f"{a}{s}{b}" for s in spaces for a in ("", "x\n", "x\r\n", "x") for b in ("", "\n", "\ny", "\r\ny", "\n\ny")), "a\nb\nc", " a\n b ", "\u200b\ny"]
    lines = text.lines(F.col("content"))
    rows = table(spark, [{"content": t} for t in texts], "content string").select(
        "content", lines.alias("lines"), text.has_blank_line(F.col("content")).alias("blank"), ex.text_line_above(lines).alias("above")
    )
    got = rows.withColumn("empty", F.transform("lines", text.is_blank)).collect()
    for r in got:
        # A line of nothing is looked for wherever one has another one behind it.
        assert r.blank or not any(r.empty[:-1]), r.content
        if not r.blank:
            assert r.above == list(range(-1, len(r.lines) - 1)), r.content
    assert any(not r.blank and len(r.lines) > 1 for r in got) and not next(r.blank for r in got if r.content == "a\nb\nc")


def test_tasks_of_the_corpus_follow_its_rows(spark, tmp_path, monkeypatch):
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double"
    rows = [{"l_orderkey": i, "l_partkey": i, "l_suppkey": i, "l_linenumber": 1, "l_extendedprice": 1.0} for i in range(200)]
    table(spark, rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    slots = spark.sparkContext.defaultParallelism
    assert P.corpus(spark, str(tmp_path)).rdd.getNumPartitions() == P.TASKS_A_SLOT * slots
    monkeypatch.setattr(P, "FILES_A_TASK", 1)
    assert P.corpus(spark, str(tmp_path)).rdd.getNumPartitions() == max(200, P.TASKS_A_SLOT * slots)
