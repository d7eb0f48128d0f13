"""The scan's generated methods are small enough to be compiled; what was rewritten for that gives the same."""

from pyspark.sql import functions as F

from contract.registry import Context
from shorewatch import model
from shorewatch import values as V
from shorewatch.functions import text
from shorewatch.operators.exemptions import apply_config
from shorewatch.sources.rules import table

#: Bytes of a method beyond which Java only interprets it.
HUGE = 8000


def test_methods_of_the_scan_are_compiled(spark, tmp_path):
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double"
    rows = [{"l_orderkey": 1, "l_partkey": 2, "l_suppkey": 3, "l_linenumber": 1, "l_extendedprice": 9.5}]
    table(spark, rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = Context(spark, str(tmp_path)).inline._jdf.queryExecution().executedPlan()
        stages = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq(plan)
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sizes and 0 < max(sizes) <= HUGE


def test_lines_are_split_once(spark):
    texts = ["", "\n", "\r\n", "\r", "a", "a\n", "a\r", "a\r\r\n", "a\r\r", "\n\n", "a\n\nb", "a\r\nb\rc\r\n", "\r\n\r", "é𝔸\n", "é𝔸\r\n\n", "a\n\r", None]

    def split(content):
        if content is None:
            return None
        parts = content.split("\n")
        # One \r before a terminator or the end of the text goes with it.
        parts = [p[:-1] if p.endswith("\r") else p for p in parts]
        return parts[:-1] if content == "" or content.endswith("\n") else parts

    rows = [{"n": i, "content": t} for i, t in enumerate(texts)]
    got = {r.n: r.lines for r in table(spark, rows, "n int, content string").select("n", text.lines(F.col("content")).alias("lines")).collect()}
    assert got == {i: split(t) for i, t in enumerate(texts)}


def test_paths_without_the_text_of_a_glob_are_told_apart(spark):
    # (glob, path, whether it matches)
    cases = [
        ("**", "x", True), ("", "x", True), ("*/?", "a/b", True), ("*/?", "a/bc", False), ("**/F1*", "F1", True), ("**/F1*", "d/F12", True),
        ("**/F1*", "d/G12", False), ("a?c*", "abcd", True), ("a?c*", "abd", False), ("**/**", "a/b", True), ("a.b", "a.b", True), ("a.b", "aXb", False),
        ("src/**/vault/**", "src/vault", True), ("src/**/vault/**", "src/x/vaults/y", False), ("*é𝔸", "xé𝔸", True), ("*é𝔸", "é", False),
    ]
    entries = [{"source": str(i), "ord": 0, "rule": "", "path": g, "reason": "r", "owner": "", "until": ""} for i, (g, _, _) in enumerate(cases)]
    found = [{"source": str(i), "file": f, "rule_id": "r", "line": 1, "status": V.ACTIVE} for i, (_, f, _) in enumerate(cases)]
    as_of = F.lit("2026-04-19 12:00:00+00:00").cast("timestamp")
    got = apply_config(table(spark, found, model.FINDINGS), table(spark, entries, model.CONFIG_EXEMPTIONS), as_of)
    assert {int(r.source): r.status == V.EXEMPTED for r in got.collect()} == {i: want for i, (_, _, want) in enumerate(cases)}
