"""Prefix trie of conversations with totals by centroid decomposition.

A node is a distinct sequence of first turns, told by 128 bits that are folded from the hashes of its turns; its
owner is the smallest conversation that begins with it, so owner and depth name it.  Each conversation owns one
stretch of a path, and the owner of a node's ancestor at any depth is looked up by the node's owner.

Totals over subtrees come from the forest of parent edges.  In each round every component is split at its
centroid, the lowest node with more than half of the component below it; the nodes with more than half are the
path from the centroid to the top.  The total of what lies at or below the centroid in the component is final
for the centroid, and is added to every other node of the path.  The parts below the centroid's children and
the part above go on as components of their own, each at most half as large, so rounds are few and no chain,
star or heavy path is walked.  Components of bounded size are finished by the same steps inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shorewatch.llm.common import materialize
from shorewatch.operators.positions import numbered

#: Nodes of a component that is finished in a task, turns of a piece of a conversation, ids that are hashed at once.
IN_TASK, PIECE, IDS = 20_000, 1024, 4096


def numbered_turns(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, at, one, two, n_bytes): each turn's place from 1, its content as 128 bits, and the bytes of its text.

    Turns go by their number, null first; equal numbers by role and then by the hash of the text.  Null role or
    text becomes empty; rows without conversation take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.md5(text.cast("binary"))).alias("hash"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    placed = numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")], "at")
    return placed.select("conv_id", "at", F.xxhash64("hash", "role").alias("one"), F.xxhash64(F.lit(7), "role", "hash").alias("two"), "n_bytes")


def branched(turns: DataFrame, ids: DataFrame, head: Column, origin: Column, most: int) -> DataFrame:
    """(conv_id, depth, one, two, n_bytes): the first ``head`` turns of ``origin`` (``most`` at most), then the own turns after so many.

    ``head`` and ``origin`` are expressions of conv_id.
    """
    plan = ids.select("conv_id", head.cast("long").alias("head"), origin.cast("long").alias("origin"))
    begins = turns.where(F.col("at") <= most).withColumnRenamed("conv_id", "origin")
    taken = plan.join(begins, "origin").where(F.col("at") <= F.col("head"))
    taken = taken.select("conv_id", F.col("at").alias("depth"), "one", "two", "n_bytes")
    counts = begins.groupBy("origin").agg(F.count("*").alias("there"))
    skip = plan.join(counts, "origin", "left").select("conv_id", "head", F.least("head", F.coalesce("there", F.lit(0))).alias("taken"))
    rest = turns.join(skip, "conv_id").where(F.col("at") > F.col("head"))
    return taken.unionByName(rest.select("conv_id", (F.col("taken") + F.col("at") - F.col("head")).alias("depth"), "one", "two", "n_bytes"))


def with_prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, n_bytes): the keys of every prefix and of the prefix before, from the root on.

    A key folds the hashes of (depth, turn).  Long conversations are folded in pieces, each from the fold of
    those before, so no window runs over one whole.
    """
    rows = turns.select(
        "conv_id", "depth", F.expr(f"(depth - 1) div {PIECE}").alias("piece"), "n_bytes",
        F.xxhash64(F.lit(1), "depth", "one", "two").alias("e1"), F.xxhash64(F.lit(2), "depth", "two", "one").alias("e2"),
    )
    so_far = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("conv_id", "piece").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    pieces = pieces.select("conv_id", "piece", *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    later = materialize(pieces.where("piece > 0"), "pieces")
    folded = rows.withColumns({f"k{i}": F.bit_xor(f"e{i}").over(so_far) for i in (1, 2)}).join(later, ["conv_id", "piece"], "left")
    key = {f"k{i}": F.col(f"k{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)}
    folded = folded.withColumns(key).withColumns({f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}")) for i in (1, 2)})
    columns = ["conv_id", "depth", "k1", "k2", "p1", "p2", "n_bytes"]
    zero = F.lit(0).cast("long")
    roots = ids.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in columns[2:]])
    return folded.select(*columns).unionByName(roots)


def pack_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids that end at one node, sorted, as comma-joined pieces of up to ``IDS`` ids."""
    for batch in batches:
        owner, depth, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1]))))
        rows = []
        for a, b in zip(new, [*new[1:], len(ids)], strict=True):
            for low in range(a, b, IDS):
                own = ids[low : min(low + IDS, b)]
                rows.append((int(owner[a]), int(depth[a]), int(own[0]), ",".join(map(str, own.tolist()))))
        names = ["owner", "depth", "first", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, which come in order; only one piece is held."""
    now, running, out = None, None, []

    def told() -> pa.RecordBatch:
        columns = [pa.array([r[0][i] for r in out], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in out], pa.string())], ["owner", "depth", "ends_sha256"])

    for batch in batches:
        for owner, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (owner, depth) == now:
                running.update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((now, running.hexdigest()))
            now, running = (owner, depth), sha256(ids.encode())
        yield told()
        out.clear()
    if now is not None:
        out.append((now, running.hexdigest()))
        yield told()


TOTALS = ["leaves", "saved"]
STATE = ["owner", "depth", "above", "top", "top_depth", "total", "size", *TOTALS, *[f"add_{t}" for t in TOTALS]]
DONE = "owner long, depth long, leaves long, saved long"


def split(state: DataFrame, lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over all components: (what is final of their centroids, the state of the rest)."""
    comp = ["top", "top_depth"]
    heavy = state.where(F.col("size") * 2 > F.col("total"))
    # Sizes fall along the path, so its lowest node has the least.
    centroid = F.min_by(F.struct("owner", "depth", "size"), "size").alias("c")
    cents = materialize(heavy.groupBy(*comp).agg(centroid).select(*comp, "c.*").toDF(*comp, "c_owner", "c_depth", "c_size"), "centroids")
    inside = state.join(cents, comp)
    children = inside.where((F.col("depth") == F.col("c_depth") + 1) & (F.col("above") == F.col("c_owner")))
    children = children.select(*comp, F.col("owner").alias("child"), F.col("size").alias("child_size"))
    # Owners with nodes deeper than the centroid: the ancestor of those nodes right below its depth is their new top, if
    # it is the centroid's child.
    deeper = inside.where(F.col("depth") > F.col("c_depth")).select(*comp, F.col("owner").alias("o"), (F.col("c_depth") + 1).alias("d")).distinct()
    below = deeper.join(lookup, (F.col("o") == F.col("conv_id")) & (F.col("d") == F.col("at"))).select(*comp, "o", F.col("is").alias("child"))
    below = materialize(below.join(children, [*comp, "child"]).withColumnRenamed("o", "owner"), "below")
    moved = inside.join(below, [*comp, "owner"], "left").withColumn("under", F.col("child").isNotNull() & (F.col("depth") > F.col("c_depth")))
    moved = moved.withColumn("centre", (F.col("owner") == F.col("c_owner")) & (F.col("depth") == F.col("c_depth")))
    moved = materialize(moved, "moved")
    sums = moved.where("under OR centre").groupBy(*comp).agg(*[F.sum(t).alias(f"sum_{t}") for t in TOTALS])
    moved = moved.join(materialize(sums, "sums"), comp)
    done = moved.where("centre").select("owner", "depth", *[(F.col(f"add_{t}") + F.col(f"sum_{t}")).alias(t) for t in TOTALS])
    path = (F.col("size") * 2 > F.col("total")) & ~F.col("under")
    rest = moved.where("NOT centre").select(
        "owner", "depth", "above",
        F.when(F.col("under"), F.col("child")).otherwise(F.col("top")).alias("top"),
        F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        F.when(F.col("under"), F.col("child_size")).otherwise(F.col("total") - F.col("c_size")).alias("total"),
        F.when(path, F.col("size") - F.col("c_size")).otherwise(F.col("size")).alias("size"),
        *TOTALS,
        *[(F.col(f"add_{t}") + F.when(path, F.col(f"sum_{t}")).otherwise(0)).alias(f"add_{t}") for t in TOTALS],
    )
    return done, rest


def split_in_task(rows: pd.DataFrame) -> pd.DataFrame:
    """All rounds of whole components."""
    owner, depth, above = (rows[c].to_numpy(np.int64) for c in ("owner", "depth", "above"))
    n, size = len(rows), rows["size"].to_numpy(np.int64).copy()
    weight = rows[TOTALS].to_numpy(np.int64)
    added = rows[[f"add_{t}" for t in TOTALS]].to_numpy(np.int64).copy()
    place = pd.MultiIndex.from_arrays([owner, depth])
    up = place.get_indexer(pd.MultiIndex.from_arrays([above, depth - 1]))
    here = np.arange(n)
    # A top's parent, where it is in the task at all, belongs to another component.
    tops = rows["top"].to_numpy(np.int64)
    top_depth = rows["top_depth"].to_numpy(np.int64)
    is_top = (owner == tops) & (depth == top_depth)
    up = np.where(is_top | (up < 0), here, up)
    alive, final = np.ones(n, bool), np.zeros_like(weight)
    while alive.any():
        # The component of a node is named by its top, found by doubling.
        top = up.copy()
        while (top[top] != top).any():
            top = top[top]
        heavy = np.flatnonzero(alive & (2 * size > size[top]))
        by = heavy[np.lexsort((size[heavy], top[heavy]))]
        centre = by[np.concatenate(([True], top[by[1:]] != top[by[:-1]]))]
        at = np.full(n, -1)
        at[top[centre]] = centre
        mid = at[top]
        # Below the centroid or at it: its subtree, cut from the parent, has the centroid as its top.
        cut = up.copy()
        cut[centre] = centre
        while (cut[cut] != cut).any():
            cut = cut[cut]
        under = alive & (cut == mid)
        sums = np.zeros_like(weight)
        np.add.at(sums, mid[under], weight[under])
        final[centre] = added[centre] + sums[centre]
        path = heavy[~under[heavy]]
        added[path] += sums[mid[path]]
        size[path] -= size[mid[path]]
        alive[centre] = False
        child = alive & np.isin(up, centre)
        up[child] = here[child]
        up[centre] = centre
    return pd.DataFrame({"owner": owner, "depth": depth, "leaves": final[:, 0], "saved": final[:, 1]})


def subtree_totals(nodes: DataFrame, lookup: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(owner, depth, leaves, saved): of each node the sums over its subtree.

    ``nodes`` has owner, depth, the parent's owner in ``above``, the size of the subtree and the two weights, of one
    tree or a forest whose tops are at depth 0; ``lookup`` has the owner (is) of the node of each conversation
    (conv_id) at each depth (at).
    """
    tops = nodes.where("depth = 0").select(F.col("owner").alias("top"), F.col("size").alias("total"))
    zero = F.lit(0).cast("long")
    # All nodes hang from one root, whose size is one number.
    root = tops.first()
    if root is None:
        return nodes.select("owner", "depth", *TOTALS)
    state = nodes.withColumns(
        {"top": F.lit(root["top"]).cast("long"), "top_depth": zero, "total": F.lit(root["total"]).cast("long")} | {f"add_{t}": zero for t in TOTALS}
    )
    # Written, so that the one top is a key like any other and not a constant that joins lose.
    state = materialize(state.select(*STATE), "state")
    done, small, most = [], [], root["total"]
    while most > in_task:
        now, rest = split(state, lookup)
        done.append(now)
        rest = materialize(rest, "state")
        small.append(rest.where(F.col("total") <= in_task))
        state = rest.where(F.col("total") > in_task)
        most = state.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    if not small:
        small = [state]
    left = small[0]
    for frame in small[1:]:
        left = left.unionByName(frame)
    tasks = max(1, ceil(root["total"] / in_task))
    found = left.groupBy(F.pmod(F.xxhash64("top", "top_depth"), F.lit(tasks))).applyInPandas(split_in_task, DONE)
    for frame in done:
        found = found.unionByName(frame)
    return found


def prefix_trie(turns: DataFrame, ids: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """One row per node of the trie of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``turns`` has conv_id, depth from 1 without gaps, the turn's content in two hashes and n_bytes; ``ids`` the
    conversations, also those without turns, each once.  conv_id is a node's smallest member; n_leaves counts the
    childless nodes of its subtree and saved_tokens sums there each node's (n_convs - 1) times n_bytes; ends_sha256
    is of the members that end at the node, ascending and joined by commas.

    * Conversations that are equal share all nodes; those without turns end at the root.
    * An empty table of conversations has no root and gives no rows.
    """
    rows = materialize(with_prefixes(turns, ids), "prefixes")
    node = ["depth", "k1", "k2"]
    nodes = rows.groupBy(*node).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = materialize(nodes, "nodes")
    lookup = materialize(rows.join(nodes.select(*node, F.col("owner").alias("is")), node).select("conv_id", F.col("depth").alias("at"), "is"), "lookup")
    # What a conversation owns begins where it is first the smallest and goes on to its end.
    ends = lookup.groupBy("conv_id").agg(F.max("at").alias("last"), F.min(F.when(F.col("is") == F.col("conv_id"), F.col("at"))).alias("begin"), F.max_by("is", "at").alias("owner"))
    ends = materialize(ends, "ends")
    # Nodes of each subtree: of every member what it owns from there on.
    owned = lookup.join(ends.where("begin IS NOT NULL").select("conv_id", "last", "begin"), "conv_id")
    below = F.greatest(F.col("last") - F.greatest("begin", "at") + 1, F.lit(0))
    sizes = owned.groupBy(F.col("is").alias("owner"), F.col("at").alias("depth")).agg(F.sum(below).alias("size"))
    parents = lookup.select(F.col("conv_id").alias("owner"), (F.col("at") + 1).alias("depth"), F.col("is").alias("above"))
    tree = nodes.join(parents, ["owner", "depth"], "left").join(sizes, ["owner", "depth"])
    tree = materialize(tree.select("owner", "depth", "above", "n_convs", "n_bytes", "size"), "tree")
    children = tree.where("depth > 0").groupBy(F.col("above").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    weighed = tree.join(children, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    weighed = weighed.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")})
    weighed = materialize(weighed, "weighed")
    totals = subtree_totals(weighed.select("owner", "depth", F.coalesce("above", "owner").alias("above"), "size", *TOTALS), lookup, in_task)
    ended = ends.select("owner", F.col("last").alias("depth"), "conv_id").repartitionByRange("owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id")
    packed = materialize(ended.mapInArrow(pack_ids, "owner long, depth long, first long, ids string"), "packed")
    packed = packed.repartition(F.col("owner"), F.col("depth")).sortWithinPartitions("owner", "depth", "first")
    hashes = packed.mapInArrow(hash_ids, "owner long, depth long, ends_sha256 string")
    found = weighed.drop(*TOTALS).join(totals, ["owner", "depth"]).join(hashes, ["owner", "depth"], "left")
    return found.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("above").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_ids(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    return conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id")).distinct()


__all__ = ["branched", "conversation_ids", "numbered_turns", "prefix_trie"]
