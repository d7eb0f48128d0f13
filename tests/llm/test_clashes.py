"""Columns of clashing names, and rows whose ids repeat or are null."""

import corpus_pipeline
from shorewatch.llm.lines import dedup_lines
from shorewatch.llm.packing import Capacity, pack_pieces
from shorewatch.llm.warc import read_archive, write_archive


def test_lines_keep_columns_of_working_names(spark):
    rows = [(1, "same line here\nown", "g", 2, 3), (2, "same line here\nother", "h", 4, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _id int, _hash int")
    got = sorted(map(tuple, dedup_lines(frame, equal_chars=1).collect()))
    assert got == [(1, "same line here\nown", "g", 2, 3, 2, 0), (2, "other", "h", 4, 5, 2, 1)]


def test_pieces_keep_columns_of_working_names(spark):
    rows = [(i, 0, 0, 1 + i % 7, f"s{i}", i, 5) for i in range(50)]
    frame = spark.createDataFrame(rows, "id long, piece int, start long, length long, shard string, filled int, offset int")
    packed = pack_pieces(frame, Capacity(tokens=10, attention=100), shard_pieces=8).collect()
    assert sorted((r.id, r.shard, r.filled) for r in packed) == [(i, f"s{i}", i) for i in range(50)]
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= 10 and sum(r.length**2 for r in own) <= 100


def test_pages_of_one_id_and_key_and_without_id(spark, tmp_path):
    pages = [
        (1, "http://a.org/x", "one"), (1, "https://A.org/x", "two"), (1, "http://a.org/x", "one"), (2, "http://a.org/y", "one"),
        (None, "http://a.org/x", "one"), (None, "http://a.org/z", "alone"), (None, "http://a.org/z", "alone"), (None, None, None), (3, None, None),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    archive = write_archive(frame, f"file://{tmp_path}/warc")
    got = sorted(
        ((r.page_id, bytes(r.payload or b"").decode(), r.record_type, r.refers_to) for r in read_archive(archive, frame).drop("payload_bytes").collect()),
        key=repr,
    )
    told = [(p, t if k == "response" else None, k, f) for p, t, k, f in got]
    want = [
        (1, "one", "response", None), (1, "two", "response", None), (1, "one", "response", None), (2, None, "revisit", 1),
        (None, None, "revisit", 1), (None, "alone", "response", None), (None, "alone", "response", None), (None, None, "revisit", 3), (3, "", "response", None),
    ]
    assert sorted(told, key=repr) == sorted(want, key=repr)


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (None, text), (None, text), (5, "quite another text with words of its own"), (5, text + " eleven"), (None, "alone"), (6, None), (7, "")]
    frame = spark.createDataFrame([(k, t, None, "s") for k, t in rows], "doc_id long, text string, lang string, source string")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()), key=repr)
    want = [(1, text), (5, "quite another text with words of its own"), (None, "alone"), (6, None), (7, "")]
    assert kept == sorted(want, key=repr)
