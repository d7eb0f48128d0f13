"""Decontamination against word lists compared window by window."""

import random
import re
from hashlib import sha256

import pytest

from shorewatch.llm.decontam import decontaminate, longest_matches, mark_contaminated


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute_force(text, items, window):
    own, hit, names = words(text), set(), set()
    for key, item in items:
        theirs = words(item)
        size = min(window, len(theirs))
        if key is None or not size:
            continue
        windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)}
        for p in range(len(own) - size + 1):
            if tuple(own[p : p + size]) in windows:
                hit.update(range(p, p + size))
                names.add(str(key))
    return len(own), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def sample(seed, alphabet=4):
    pick = random.Random(seed)
    text = lambda n: pick.choice([" ", ", ", "\n"]).join(pick.choice("AaBbÉéDdEf"[:alphabet]) + pick.choice("xy") for _ in range(n))
    items = [(i, text(pick.choice([1, 2, 3, 5, 9]) if i > 2 else 12)) for i in range(12)]
    items += [(3, text(6)), (None, text(5)), (20, None), (21, ""), (22, "...")]
    docs = [(i, text(pick.choice([0, 1, 4, 30, 200]))) for i in range(40)]
    docs += [(7, "repeated id " + text(20)), (None, text(15)), (50, None), (51, ""), (52, items[0][1]), (53, items[0][1])]
    return docs, items


@pytest.mark.parametrize(("seed", "item_bytes", "shard_bytes"), [(1, 1 << 20, 1 << 20), (2, 40, 1 << 20), (3, 1 << 20, 50)])
def test_marks_equal_brute_force(spark, seed, item_bytes, shard_bytes):
    docs, items = sample(seed, 10)
    found = mark_contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        window=4, item_bytes=item_bytes, shard_bytes=shard_bytes,
    )
    want = sorted(repr((k, *brute_force(t, items, 4))) for k, t in docs)
    assert sorted(repr(tuple(r)) for r in found.collect()) == want
    assert any("True" in x for x in want) and any("False" in x for x in want)


@pytest.mark.parametrize("item_bytes", [1 << 20, 60])
def test_clean_documents_stay_with_all_columns(spark, item_bytes):
    docs, items = sample(4, 10)
    rows = [(k, t, "own", i) for i, (k, t) in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_hit string, row long")
    kept = decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), 4, item_bytes=item_bytes)
    want = [r for r in rows if not brute_force(r[1], items, 4)[-1]]
    assert kept.columns == frame.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want)) and 0 < len(want) < len(rows)


@pytest.mark.parametrize("item_bytes", [1 << 20, 60])
def test_longest_matches_equal_brute_force(spark, item_bytes):
    docs, items = sample(5, 10)
    items = [x for x in items if x[0] != 3]
    docs = [x for x in docs if x[0] is not None]
    found = longest_matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
        window=4, item_bytes=item_bytes,
    ).collect()
    texts, names = [words(t) for _, t in docs], {str(k): words(t) for k, t in items if k is not None}
    want = {}
    for key, item in names.items():
        size = min(4, len(item))
        for i in range(len(item) - size + 1) if size else ():
            most = 0
            for text in texts:
                for p in range(len(text)):
                    n = 0
                    while i + n < len(item) and p + n < len(text) and item[i + n] == text[p + n]:
                        n += 1
                    most = max(most, n)
            if most >= size:
                want[key, i] = most
    assert {(r.item_id, r.item_word): r.words for r in found} == want
    by_id = {}
    for k, t in docs:
        by_id.setdefault(k, []).append(words(t))
    for r in found:
        here = names[r.item_id][r.item_word : r.item_word + r.words]
        assert any(t[r.doc_word : r.doc_word + r.words] == here for t in by_id[r.doc_id])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert mark_contaminated(docs, items).count() == 0
    assert [r.contaminated for r in mark_contaminated(some, items).collect()] == [False]
    assert decontaminate(some, items).count() == 1 and longest_matches(some, items).count() == 0


def test_very_long_text(spark):
    long = "filler " * 300_000
    docs = [(1, long + "one two three four " + long), (2, long)]
    items = [(1, "One two, three FOUR."), (2, "filler filler")]
    found = mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in found.collect()}
    assert got == {1: (600_004, 600_004, 2), 2: (300_000, 300_000, 1)}
