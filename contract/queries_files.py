"""Readers of folders and files: what the other queries derive as tables is written to shared storage and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contract import oracle_base as O
from contract import queries_scan as S
from contract.registry import Context, query
from shorewatch import values as V
from shorewatch.operators.scan import select_files
from shorewatch.operators.tables import shared_directory, written
from shorewatch.sources.exemptions import exemptions_from_checkouts
from shorewatch.sources.files import files_from_tree
from shorewatch.sources.rule_files import rules_from_folders
from shorewatch.sources.targets import targets_from_yaml


def write_files(files: DataFrame, root: str) -> None:
    """Each row (file, content) as a file below the root, written in the tasks."""

    def put(batches):
        import os

        import pandas as pd
        from pyarrow import fs

        from shorewatch.sources.trees import _uri

        made = set()
        for batch in batches:
            system, inside = fs.FileSystem.from_uri(_uri(root))
            for file, content in zip(batch["file"], batch["content"], strict=True):
                path = f"{inside}/{file}"
                if (folder := os.path.dirname(path)) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(path, compression=None) as f:
                    f.write(content.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("file", "content").mapInPandas(put, "n long").agg(F.sum("n")).collect()


def _slug(column: Column) -> Column:
    return F.replace(column, F.lit("/"), F.lit("-"))


def _folder(c: Context, name: str) -> str:
    return shared_directory(c.spark, f"{name}-{uuid4().hex}")


@query(
    "s1_file_tree",
    O.from_selected("SELECT replace(source, '/', '-') AS source, file, lang, sha256(content) AS content_hash FROM selected"),
)
def s1_file_tree(c: Context) -> DataFrame:
    """The planted corpus as checkouts on storage: listed, filtered by path and read."""
    root = _folder(c, "checkouts")
    write_files(c.corpus.select(F.concat(_slug(F.col("source")), F.lit("/"), F.col("file")).alias("file"), "content"), root)
    found = select_files(files_from_tree(c.spark, root, c.pack, None), c.pack)
    return found.select("source", "file", "lang", F.sha2("content", 256).alias("content_hash"))


_RULE_FIELDS = ("id", "language", "pattern", "severity", "quantum_threat", "primitive")


@query(
    "s3_rule_files",
    f"""WITH {S._RULE_TABLE}
        SELECT layer, file, row_number() OVER (PARTITION BY layer, file ORDER BY pos) - 1 AS pos, {", ".join(_RULE_FIELDS)},
          array_to_string(extensions, ' ') AS extensions FROM rule_table""",
)
def s3_rule_files(c: Context) -> DataFrame:
    """Four layers of rule files, listed and parsed in the tasks."""
    root = _folder(c, "rules")
    rule = F.struct("pos", F.struct(*_RULE_FIELDS, "extensions").alias("rule"))
    files = S.rule_table(c).groupBy("layer", "file").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    name = F.concat(F.lit("layer"), F.col("layer").cast("string"), F.lit("/"), F.col("file"))
    write_files(files.select(name.alias("file"), F.to_json(F.transform("rules", lambda r: r["rule"])).alias("content")), root)
    read = rules_from_folders(c.spark, *[f"{root}/layer{n}" for n in range(4)])
    return read.select(
        F.col("layer").cast("bigint"), "file", F.col("pos").cast("bigint"), *_RULE_FIELDS, F.array_join("extensions", " ").alias("extensions")
    )


_BROKEN = "org1/repo-1"


@query(
    "s5_checkout_files",
    O.with_steps(
        f"""SELECT source, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS ord, rule, path, reason, until, false AS void
            FROM entries WHERE source <> '{_BROKEN}'
            UNION ALL SELECT '{_BROKEN}', 0, '', '', '', '', true""",
        O.EXEMPTIONS,
    ),
)
def s5_checkout_files(c: Context) -> DataFrame:
    """One configuration file a repository, one of them broken; it voids its own list only."""
    root = _folder(c, "configured")
    entry = F.struct("ord", F.struct("rule", "path", "reason", "owner", "until").alias("entry"))
    lists = c.exemptions.groupBy("source").agg(F.array_sort(F.collect_list(entry)).alias("listed"))
    text = F.to_json(F.struct(F.transform("listed", lambda e: e["entry"]).alias("exemptions")))
    text = F.when(F.col("source") == _BROKEN, F.concat(F.lit("exemptions: ["), text)).otherwise(text)
    files = lists.select(F.concat(_slug(F.col("source")), F.lit(f"/{V.CONFIG_FILE}")).alias("file"), text.alias("content"))
    write_files(files, root)
    roots = c.exemptions.select("source").distinct().withColumn("root", F.concat(F.lit(f"{root}/"), _slug(F.col("source"))))
    read = exemptions_from_checkouts(c.spark, written(roots, "roots"))
    void = F.startswith("owner", F.lit("unreadable"))
    return read.select("source", F.col("ord").cast("bigint").alias("ord"), "rule", "path", "reason", "until", void.alias("void"))


@query("s6_target_files", O.with_steps("SELECT name, repo, category, description FROM targets", O.TARGETS))
def s6_target_files(c: Context) -> DataFrame:
    """Target lists, one file for each category."""
    root = _folder(c, "targets")
    target = F.struct("name", "repo", "category", "description")
    lists = written(c.targets.groupBy("category").agg(F.collect_list(target).alias("targets")), "targets")
    name = F.concat(F.col("category"), F.lit(".yaml"))
    write_files(lists.select(name.alias("file"), F.to_json(F.struct("targets")).alias("content")), root)
    # One path for each category.
    paths = [f"{root}/{r.category}.yaml" for r in lists.select("category").collect()]
    return targets_from_yaml(c.spark, *paths).select("name", "repo", "category", "description")
