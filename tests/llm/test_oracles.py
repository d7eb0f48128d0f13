"""Registered corpus queries against their SQL, and what SQL can't express against brute force, on small tables."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from shorewatch.llm import queries as Q
from shorewatch.llm.licenses import BASE
from shorewatch.llm.substrings import remove_repeats

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = Q.QUERIES[name](spark, SF), duck.sql(Q.ORACLES[name])
    columns = sorted(ours.columns)
    assert sorted(theirs.columns) == columns
    got = sorted(tuple(map(repr, r)) for r in ours.select(*columns).collect())
    want = sorted(tuple(map(repr, r)) for r in theirs.project(", ".join(columns)).fetchall())
    assert got == want and got


def documents(spark, n=200):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(n).collect()]


@pytest.mark.parametrize("at_once", [2, 1500])
def test_repeats_equal_brute_force(spark, at_once):
    """With two fragments at once nearly every anchor takes the packed path."""
    docs, length = documents(spark), 60
    count = Counter(b[i : i + length] for _, t in docs for b in [t.encode()] for i in range(len(b) - length + 1))
    want = {}
    for key, text in docs:
        raw, gone = text.encode(), set()
        for i in range(len(raw) - length + 1):
            if count[raw[i : i + length]] > 1:
                gone.update(range(i, i + length))
        runs = sum(1 for i in gone if i - 1 not in gone)
        kept = bytes(c for i, c in enumerate(raw) if i not in gone)
        want[key] = (len(raw), len(gone), runs, sha256(kept).hexdigest())
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = remove_repeats(frame, length, gram=20, fragments_at_once=at_once).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want
    assert any(x[1] for x in want.values())


def test_packing_is_whole_and_tight(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = Q.op2(spark, SF).toPandas()
    for key, text in documents(spark):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        mine = rows[rows.doc_id == key].sort_values("piece")
        assert mine.piece.tolist() == list(range(-(-len(ids) // 2048)))
        for r in mine.itertuples():
            piece = ids[r.start : r.start + 2048]
            assert r.start == 2048 * r.piece and r.length == len(piece)
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
    for _, sequence in rows.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum().tolist()[:-1]]
        assert sequence.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= 1.02 * rows.length.sum() / 2048 + 1


def test_licenses_equal_brute_force(spark):
    rows = {r.doc_id: r for r in Q.op6(spark, SF).collect()}
    for key, text in documents(spark):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [
            (i, label)
            for phrase, label in BASE.items()
            for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        ]
        r, starts = rows[key], [p for p, _ in places]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        labels = [x for x in r.labels.split(",") if x]
        assert labels == sorted(set(labels)) and {x for _, x in places} <= set(labels) and 0 <= r.score <= 1


def test_language_is_found_on_held_out_rows(spark):
    rows = Q.op9(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(truth, "doc_id")
    assert held.count() > 200
    assert held.where(F.col("lang") == F.col("lang_pred")).count() >= 0.98 * held.count()
    assert rows.where("score < 0 OR score > 1").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_lines_equal_brute_force(spark):
    from shorewatch.llm.lines import dedup_lines

    base = ["the quick brown fox jumps over it", "a wholly different line of words", "short", "ünï çödé lïne wïth lêttèrs ok"]
    docs = []
    for i in range(40):
        x = base[i % 4]
        edits = [x, x[:5] + "Z" + x[6:], x[1:], x + "!", x[:9] + "qq" + x[11:], "Q" * 3 + x[3:]]
        docs.append((i, f"{edits[i % 6]}\nline number {i * 7919} is alone {i * i}\n{edits[(i + 1) % 6]}"))
    lines = [(k, n, s) for k, t in docs for n, s in enumerate(t.split("\n"))]
    taking = [x for x in lines if len(x[2]) >= 24]
    group = {x: x for x in taking}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, x in enumerate(taking):
        for y in taking[:i]:
            if distance(x[2], y[2]) <= 2:
                a, b = sorted((root(x), root(y)))
                group[b] = a
    gone = {x[:2] for x in taking if root(x) != x}
    want = {k: "\n".join(s for n, s in enumerate(t.split("\n")) if (k, n) not in gone) for k, t in docs}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(frame, edits=2, least_chars=24).collect()}
    assert got == want and len(gone) > 20


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        seen[name] = docs
        docs = P.materialize(stage(spark, docs, SF), name)
        if name != "packed":
            assert docs.columns == P.COLUMNS
    before, after = seen["near_duplicates"].toPandas(), seen["mix"].toPandas()

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {k: shingles(t) for k, t in zip(before.doc_id, before.text)}
    part = {k: k for k in sets}

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    keys = sorted(sets)
    for i, x in enumerate(keys):
        for y in keys[:i]:
            a, b = sets[x], sets[y]
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                low, high = sorted((root(x), root(y)))
                part[high] = low
    assert sorted(after.doc_id) == sorted(k for k in keys if root(k) == k)
    pieces = docs.toPandas()
    assert set(pieces.doc_id) <= set(after.doc_id) and len(pieces)
