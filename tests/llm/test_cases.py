"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import public_tokenizers
import pytest

from shorewatch.llm.language import fit, identify
from shorewatch.llm.licenses import Detection, scan_licenses, suppress
from shorewatch.llm.lines import dedup_lines
from shorewatch.llm.mixing import draw_mix, split_quotas, taken_words
from shorewatch.llm.neardup_docs import near_documents
from shorewatch.llm.neardup_vectors import near_vectors, nearest_e8
from shorewatch.llm.packing import Capacity, best_fit, pack_documents
from shorewatch.llm.substrings import remove_repeats
from shorewatch.llm.tokens import Encoder
from shorewatch.llm.topk import top_k
from shorewatch.llm.warc import parse, read_archive, record, url_key, write_archive

CLASHING = "node long, region string, id string, row long, rank int, labels string, size int"
DOCS = f"doc_id long, text string, lang string, source string, {CLASHING}"
LONG = "word and another one here " * 4000
TEXTS = [
    (1, "the same text of a few words here", "en", "a"),
    (2, "the same text of a few words here", "en", None),
    (2, "the same text of a few words here", "en", None),
    (3, None, None, "b"),
    (4, "", None, "b"),
    (5, "...  !!", None, "a"),
    (None, "the same text of a few words here", "fr", "a"),
    (6, LONG, "fr", "b"),
    (7, LONG + "x", None, "b"),
    (8, "one", "fr", "a"),
    (9, "MIT License and GNU General Public License v3 or later", "en", "a"),
]
ROWS = [(*x, 1, "r", "i", 2, 3, "l", 4) for x in TEXTS]
DEFINITION = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(frame, *columns):
    return sorted([tuple(r) for r in frame.select("doc_id", *columns).collect()], key=lambda r: (r[0] is None, r))


def test_near_documents(docs, none):
    got = by_id(near_documents(docs, size=3, num=9, den=10), "n_shingles", "component_id")
    assert [g for g in got if g[0] in (1, 2)] == [(1, 6, 1), (2, 6, 1), (2, 6, 1)]
    assert (3, 0, 3) in got and (4, 0, 4) in got and (None, None, None) in got
    assert [g[2] for g in got if g[0] in (6, 7)] == [6, 7] and len(got) == len(ROWS)
    assert near_documents(none).collect() == []


def test_repeats(docs, none):
    got = by_id(remove_repeats(docs, 20, gram=8), "n_bytes", "n_removed", "n_spans")
    assert [g for g in got if g[0] in (1, 2)] == [(1, 33, 33, 1), (2, 33, 33, 1), (2, 33, 33, 1)]
    assert (3, 0, 0, 0) in got and (8, 3, 0, 0) in got and (6, len(LONG), len(LONG), 1) in got
    assert remove_repeats(none).collect() == []


def test_lines(docs, none):
    got = by_id(dedup_lines(docs), "text", "n_lines", "n_removed", "rank")
    assert (3, None, 0, 0, 3) in got and (4, "", 1, 0, 3) in got and len(got) == len(ROWS)
    assert [g[3] for g in got if g[0] in (1, 2, None)] == [0, 1, 1, 1]
    assert dedup_lines(none).collect() == []


def test_language(docs, none):
    model = fit(docs)
    got = {tuple(r) for r in identify(docs, model).select("doc_id", "lang_pred", "rejected").collect()}
    assert {(3, "und", True), (4, "und", True), (5, "und", True)} <= got
    assert (1, "en", False) in got and (6, "fr", False) in got
    assert identify(none, model).collect() == []
    assert {r.lang_pred for r in identify(docs, fit(none)).collect()} == {"und"}


def test_licenses(docs, none):
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert got[9].labels == "gpl,gpl-3.0-or-later,mit" and got[9].base_labels == "gpl,mit" and got[9].n_base == 2
    assert (got[3].n_words, got[3].first_word, got[3].score) == (0, None, 0.0)
    assert scan_licenses(none).collect() == []
    inner, outer, other = Detection(2, 4, "a", 5, 1), Detection(1, 5, "b", 1, 1), Detection(4, 7, "c", 9, 1)
    assert suppress([inner, outer, other]) == [outer, other]
    assert suppress([inner, outer._replace(priority=9)]) == [inner, outer._replace(priority=9)]


def test_mix(docs, none):
    sized, mix = draw_mix(docs, [3.0, 1.0, 2.0])
    rows = taken_words(sized, mix).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    by_target = {}
    for r in rows:
        by_target.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(v) - k[1]) <= 1 for k, v in by_target.items())
    assert taken_words(*draw_mix(none, [1.0])).collect() == []
    placed = mix.collect()
    assert len({(r.shard, r.place) for r in placed}) == len(placed)


def test_splitting_tree_is_exact():
    quotas = [1000, 7, 0, 313]
    parts = [split_quotas(quotas, 5, k, 4) for k in range(5)]
    assert (sum(h for _, h in parts) == quotas).all()
    at = [0] * 4
    for low, have in parts:
        assert low.tolist() == at
        at = (low + have).tolist()


def test_packing(docs, none):
    got = pack_documents(docs, DEFINITION, with_ids=True).collect()
    assert sum(r.length for r in got if r.id == 3) == 1 and len([r for r in got if r.id == 2]) == 2
    assert all(len(r.ids) == r.length for r in got)
    assert pack_documents(none, DEFINITION).collect() == []
    with pytest.raises(ValueError):
        pack_documents(docs, DEFINITION, Capacity(tokens=2048, attention=100)).collect()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = sorted([int(x) for x in "97531864297531" * 5], reverse=True)
    capacity = Capacity(tokens=20, documents=3, attention=150, weights=(1, 1, 1), rule=rule)
    import numpy as np

    chosen = best_fit(np.array(lengths), capacity)
    for number in set(chosen.tolist()):
        mine = [x for x, c in zip(lengths, chosen) if c == number]
        assert sum(mine) <= 20 and len(mine) <= 3 and sum(x * x for x in mine) <= 150


def test_encoder_equals_library():
    encoder = Encoder(DEFINITION, remembered=3)
    assert encoder.split is not None
    letters = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = ["<|endoftext|> a", "ΑΣ ΣΑΣ", "İstanbul é É", "", " \n\x1c\x85 x", *[f"A{c}b {c}'S {c}{c}1 é{c}" for c in letters]]
    for text, want in zip(texts, encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(text) == b"".join(i.to_bytes(4, "little") for i in want.ids), repr(text)


VECTORS = f"vec_id long, embedding array<float>, {CLASHING}"
POINTS = [
    (20, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.01]), (2, [1.0, 0.01]), (40, None), (4, []), (5, [0.0, 0.0]),
    (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [0.0, -1.0]), (10, [1.0, 0.0, 0.0]),
]


def test_vectors(spark):
    frame = spark.createDataFrame([(*x, 1, "r", "i", 2, 3, "l", 4) for x in POINTS], VECTORS)
    got = sorted(map(tuple, near_vectors(frame).collect()), key=lambda r: (r[0] is None, r[:2]))
    assert [g for g in got if g[0] in (1, 2, 20)] == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (20, 3, 1, False)]
    assert (5, 0, 5, True) in got and (None, 0, None, False) in got and len(got) == len(POINTS)
    top = [tuple(r) for r in top_k(frame, k=3).orderBy("query_id", "rank").collect()]
    assert top == [(20, 1, 1, 4096), (20, 2, 2, 4096), (20, 3, 2, 4096)]
    nothing = spark.createDataFrame([], VECTORS)
    assert near_vectors(nothing).collect() == [] and top_k(nothing).collect() == []


def test_lattice_points_are_nearest():
    import numpy as np

    rng = np.random.default_rng(1)
    points = rng.normal(size=(500, 8)) * 2
    found = nearest_e8(points)
    assert (((found * 2) % 2).std(axis=1) == 0).all() and (found.sum(axis=1) % 2 == 0).all()
    assert ((points - found) ** 2).sum(axis=1).max() <= 1 + 1e-9  # the covering radius


def test_archive(spark):
    schema = f"page_id long, url string, html string, {CLASHING}"
    pages = [(3, "http://b.example.org/x?q=1", "same"), (1, "https://A.example.org:80/", "same"), (2, None, None), (5, "http://[bad", ""), (None, "u", "x"), (4, "http://b.example.org/x?q=1", "ü" * 50_000)]
    frame = spark.createDataFrame([(*x, 1, "r", "i", 2, 3, "l", 4) for x in pages], schema)
    folder = spark.conf.get("spark.checkpoint.dir") + "/archive-test"
    archive = write_archive(frame, folder, archive_bytes=400, block_lines=2)
    got = {r.page_id: r for r in read_archive(archive, frame).collect()}
    assert set(got) == {None, 1, 2, 3, 4, 5}
    assert (got[3].record_type, got[3].refers_to, got[3].payload_bytes, bytes(got[3].payload)) == ("revisit", 1, 4, b"")
    assert got[1].record_type == "response" and bytes(got[4].payload) == ("ü" * 50_000).encode()
    assert (got[2].record_type, got[5].refers_to, got[2].payload_bytes) == ("response", 2, 0)
    absent = spark.createDataFrame([(99, "http://b.example.org/x?q=1")], "page_id long, url string")
    assert read_archive(archive, absent).collect() == []
    empty = write_archive(frame.limit(0), folder + "-empty")
    assert read_archive(empty, frame).collect() == []


def test_record_round_trip():
    parsed = parse(record(7, "http://x.org/\r\na b", b"\r\n\r\nbody", None))
    assert (parsed["page_id"], parsed["payload"], parsed["refers_to"]) == (7, b"\r\n\r\nbody", None)
    assert url_key("https://www.Example.com/a?b=c") == "com,example,www)/a?b=c"
