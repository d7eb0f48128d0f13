"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of words.  How many blocks each source gives is fixed exactly; a tree then
splits these quotas between output shards, each node drawing the left half's share of every source as a
draw without replacement would.  A shard's share of a source is a range of the source's permuted blocks,
so shards are disjoint; inside a shard the blocks are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shorewatch.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, draws of an output shard, blocks of one step of the running sums.
BLOCK_WORDS, SHARD_DRAWS, STEP_BLOCKS = 256, 4096, 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Target of every source from (source, source_size): ``share`` of all words split by weight, capped, the excess reshared.

    Weights repeat over the sources in code-point order, null last.  With sources ordered by how soon
    their cap binds, those capped come first, so the level of the others follows from running sums.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy("reach", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    ordered = (
        sizes.withColumn("rank", rank)
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("reach", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * float(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("left", F.col("budget") - F.col("capped"))
        .withColumn("free", F.col("left") * F.col("weight") / F.col("open") <= F.col("cap"))
    )
    # The first source that is not capped sets the level for itself and all after it.
    level = F.min(F.when(F.col("free"), F.struct("reach", "rank", "left", "open"))).over(everything)
    below = F.struct("reach", "rank") < F.struct("level.reach", "level.rank")
    return ordered.withColumn("level", level).select(
        "source",
        "source_size",
        F.when(F.col("level").isNull() | below, F.col("cap"))
        .otherwise(F.col("level.left") * F.col("weight") / F.col("level.open"))
        .alias("target"),
    )


def split_quotas(quotas: list[int], shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's first place and number of blocks in each source: one walk down the tree.

    A node's draw depends on the seed and the node only, so every walk through it sees the same one.
    """
    low, high = 0, shards
    left_of, have = np.zeros(len(quotas), np.int64), np.array(quotas, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        size = int(have.sum()) * (middle - low) // (high - low)
        drawn = rng.multivariate_hypergeometric(have, size, method="marginals")
        if shard < middle:
            high, have = middle, drawn
        else:
            low, left_of, have = middle, left_of + drawn, have - drawn
    return left_of, have


def quota_table(spark, quotas: list[tuple[str | None, int]], shards: int, seed: int) -> DataFrame:
    """(source, shard, low, high): the places of a source's permuted draws that go to a shard."""
    names, counts = [s for s, _ in quotas], [q for _, q in quotas]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                low, have = split_quotas(counts, shards, int(shard), seed)
                yield pd.DataFrame({"source": names, "shard": shard, "low": low, "high": low + have})

    return spark.range(shards).mapInPandas(walk, "source string, shard long, low long, high long").where("high > low")


def draw_mix(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    row_col: str | None = None,
    block_words: int | None = BLOCK_WORDS,
    shard_draws: int = SHARD_DRAWS,
    seed: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """The sized documents and the mix drawn from them.

    Documents: row, id, source, size, source_size, target.  Mix: shard, place (from 0 in the shard), row,
    epoch, first_word, n_words.  ``block_words`` None makes each document one block, whole or not at all.
    ``row_col`` names unique numbers of the rows by which the caller finds them again; they are made if not given.

    * A source's taken words are its target, rounded down; with whole documents, less than one document
      more.  No document is taken more often than ``most`` rounded up, nor more than ``most`` times its size.
    * Null and empty texts have size 0 and are never drawn.  A null source is a source, last in order.
    * Null ids are allowed and repeated ids are documents of their own.  Equal runs give equal mixes.
    * An empty table gives two empty results; other columns are ignored.
    * The quotas, one number a source, pass through the driver; blocks and documents do not.
    """
    spark = docs.sparkSession
    sized = docs.select(
        (F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    sized = materialize(sized, "sized")
    length = F.lit(block_words) if block_words else F.greatest("size", F.lit(1))
    counted = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.ceil(F.col("size") / length)).alias("blocks")
    )
    targets = source_targets(counted.drop("blocks"), weights, share, most)
    plan = counted.drop("source_size").withColumnRenamed("source", "s").join(
        targets, F.col("s").eqNullSafe(F.col("source"))
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = materialize(
        plan.withColumn("epochs", whole).withColumn(
            "extra", F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
        ).drop("s"),
        "plan",
    )
    total = plan.agg(F.sum("blocks")).first()[0] or 0
    digits = max(1, ceil(np.log(max(1, total / STEP_BLOCKS)) / np.log(16)))

    block = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / length) - 1))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("block")).cast("binary"))
    words = F.least(length, F.col("size") - F.col("block") * length)
    blocks = (
        sized.where("size > 0")
        .withColumn("block", block)
        .select("row", "source", order.alias("order"), (F.col("block") * length).alias("first_word"), words.alias("n_words"))
        .withColumn("step", F.substring("order", 1, digits))
    )
    # Rank and words before a block: those of the steps before its own, and those before it in its step.
    inside = Window.partitionBy("source", "step").orderBy("order", "n_words", "row").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    ranked = (
        blocks.withColumn("r", F.coalesce(F.count("*").over(inside), none))
        .withColumn("w", F.coalesce(F.sum("n_words").over(inside), none))
    )
    earlier = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = blocks.groupBy("source", "step").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    before = steps.select(
        "source",
        "step",
        F.coalesce(F.sum("n").over(earlier), none).alias("r0"),
        F.coalesce(F.sum("words").over(earlier), none).alias("w0"),
    )
    b = before.select(F.col("source").alias("s"), F.col("step").alias("t"), "r0", "w0")
    ranked = ranked.join(b, (F.col("step") == F.col("t")) & F.col("source").eqNullSafe(F.col("s"))).select(
        "row", "source", "order", "first_word", "n_words", (F.col("r") + F.col("r0")).alias("rank"), (F.col("w") + F.col("w0")).alias("w")
    )
    p = plan.select(F.col("source").alias("s"), "blocks", "epochs", "extra")
    rest = F.least(F.col("n_words"), F.greatest(none, F.col("extra") - F.col("w")))
    if block_words is None:
        rest = F.when(F.col("w") < F.col("extra"), F.col("n_words")).otherwise(none)
    # One draw for each whole epoch, and one from the first part of the permutation for the rest.
    drawn = ranked.join(p, F.col("source").eqNullSafe(F.col("s"))).select(
        "row",
        "source",
        "order",
        "first_word",
        F.posexplode(F.concat(F.array_repeat("n_words", F.col("epochs").cast("int")), F.array(rest))).alias("epoch", "n_words"),
        (F.col("epoch") * F.col("blocks") + F.col("rank")).alias("at"),
    )
    drawn = materialize(drawn.where("n_words > 0"), "drawn")
    quotas = [(r["source"], r["q"]) for r in drawn.groupBy("source").agg(F.count("*").alias("q")).collect()]
    quotas.sort(key=lambda x: (x[0] is None, x[0] or ""))
    shards = max(1, ceil(sum(q for _, q in quotas) / shard_draws))
    ranges = quota_table(spark, quotas, shards, seed) if quotas else spark.createDataFrame([], "source string, shard long, low long, high long")
    # A range join by equal keys: each range is entered under every run of places that it reaches into.
    run = shard_draws
    reach = F.explode(F.sequence(F.floor(F.col("low") / run), F.floor((F.col("high") - 1) / run)))
    g = ranges.withColumn("run", reach).select(F.col("source").alias("s"), "shard", "low", "high", F.col("run").alias("t"))
    placed = drawn.withColumn("run", F.floor(F.col("at") / run)).join(
        g,
        (F.col("run") == F.col("t")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")),
    )
    local = Window.partitionBy("shard").orderBy(F.xxhash64("shard", "order", "epoch"), "row", "first_word")
    mix = placed.select("shard", (F.row_number().over(local) - 1).alias("place"), "row", "epoch", "first_word", "n_words")
    t = plan.select(F.col("source").alias("s"), "source_size", "target")
    return sized.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s"), mix


def taken_words(sized: DataFrame, mix: DataFrame) -> DataFrame:
    """id, size, source_size, target and the words of the mix that come from each document."""
    got = mix.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return sized.join(got, "row", "left").select(
        "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


__all__ = ["draw_mix", "source_targets", "split_quotas", "taken_words", "word_count"]
