"""The conversation trie against dictionaries of prefixes."""

import random
from collections import defaultdict
from hashlib import md5, sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shorewatch.llm.convtrie import branched, conversation_ids, hash_ids, numbered_turns, pack_ids, prefix_trie, split_in_task

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner long"


def rebuild(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, md5(text.encode()).digest(), text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    heads = {c: crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: heads[c]] + own[c][heads[c] :] for c in own}


def brute_force(rebuilt):
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for path, own in members.items():
        cost = (len(own) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += cost
            leaves[path[:d]] += path not in children
    out = set()
    for path, own in members.items():
        ends = sorted(c for c in own if len(rebuilt[c]) == len(path))
        digest = sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        out.add((min(own), len(path), parent, len(own), children.get(path, 0), leaves[path], saved[path], digest))
    return out


def trie(spark, rows, in_task):
    frame = spark.createDataFrame(rows, SCHEMA)
    ids, key = conversation_ids(frame), F.col("conv_id")
    rebuilt = branched(numbered_turns(frame), ids, F.crc32(key.cast("string").cast("binary")) % 9, key - key % 5, 8)
    found = [tuple(r) for r in prefix_trie(rebuilt, ids, in_task).collect()]
    assert len(found) == len(set(found))
    return set(found)


def sample(seed, convs):
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        hot = c % 3 == 0
        for turn in range(pick.choice([1, 2, 6, 12])):
            text = f"hot {turn}" if hot else pick.choice(["é", "b\n", "", "long text " * 3, None])
            rows.append((c * pick.choice([1, 1, 1, 7]), None if pick.random() < 0.05 else turn, pick.choice(["user", None]) if not hot else "user", text, "x", 9))
    # Equal numbers, a row twice, and a conversation that is one long chain.
    rows += [(2, 0, "user", "tie a", "x", 1), (2, 0, "user", "tie b", "x", 1), (2, 0, "user", "tie b", "x", 1), (None, 0, "user", "no id", "x", 1)]
    return rows + [(10_000, t, "user", f"chain {t % 3}", "x", 1) for t in range(60)]


@pytest.mark.parametrize(("seed", "convs", "in_task"), [(1, 60, 20_000), (2, 40, 3)])
def test_trie_equals_brute_force(spark, seed, convs, in_task):
    """Three nodes in a task: nearly all rounds are jobs."""
    rows = sample(seed, convs)
    assert trie(spark, rows, in_task) == brute_force(rebuild(rows))


def test_conversations_in_pieces(spark, monkeypatch):
    monkeypatch.setattr("shorewatch.llm.convtrie.PIECE", 4)
    rows = sample(3, 20)
    assert trie(spark, rows, 50) == brute_force(rebuild(rows))


def test_empty_and_turnless(spark):
    assert trie(spark, [], 10) == set()
    # Conversation 1 takes its head from a conversation that is not there and loses all its turns but those after it.
    rows = [(c, 0, "user", "only", "x", 1) for c in (1, 2, 3, 4, 6)]
    got = trie(spark, rows, 10)
    assert got == brute_force(rebuild(rows)) and any(r[1] == 0 for r in got)


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_split_in_task_sums_subtrees(shape):
    n, pick = 500, random.Random(7)
    parent = [0] + [{"chain": i - 1, "star": 0, "random": pick.randrange(max(0, i - 9), i)}[shape] for i in range(1, n)]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    weight = [pick.randrange(100) for _ in range(n)]
    size, total = [1] * n, list(weight)
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        total[parent[i]] += total[i]
    frame = pd.DataFrame({"owner": range(n), "depth": depth, "above": parent, "top": 0, "top_depth": 0, "total": n, "size": size, "leaves": weight, "saved": 1, "add_leaves": 5, "add_saved": 0})
    got = split_in_task(frame.sample(frac=1, random_state=1)).set_index("owner")
    assert got["leaves"][list(range(n))].tolist() == [t + 5 for t in total]
    assert got["saved"][list(range(n))].tolist() == size


def test_hashes_of_many_pieces():
    import pyarrow as pa

    ids = list(range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(ids) + [5]), pa.array([3] * len(ids) + [1]), pa.array([*ids, 5])], ["a", "b", "c"])
    found = [r for out in hash_ids(pack_ids([batch.slice(0, 7), batch.slice(7)])) for r in out.to_pylist()]
    assert [r["ends_sha256"] for r in found] == [sha256(",".join(map(str, x)).encode()).hexdigest() for x in (ids, [5])]
    assert np.array([r["depth"] for r in found]).tolist() == [3, 1]
