"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorewatch.llm.common import materialize, shared_folder, table
from shorewatch.llm.convtrie import branched, conversation_ids, numbered_turns, prefix_trie
from shorewatch.llm.decontam import mark_contaminated
from shorewatch.llm.lexical import rank_documents
from shorewatch.llm.language import fit, held_out, identify
from shorewatch.llm.licenses import scan_licenses
from shorewatch.llm.lines import dedup_lines
from shorewatch.llm.mixing import draw_mix, taken_words
from shorewatch.llm.neardup_docs import near_documents
from shorewatch.llm.neardup_vectors import near_vectors
from shorewatch.llm.packing import pack_documents
from shorewatch.llm.substrings import remove_repeats
from shorewatch.llm.topk import top_k
from shorewatch.llm.warc import read_archive, write_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


USABLE = (
    "embedding IS NOT NULL AND len(embedding) > 0 AND "
    "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
)


@query(
    "op5_lattice_neardup",
    f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE {USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT a AS node, b AS other FROM link
  UNION SELECT r.node, l.b FROM reach r JOIN link l ON r.other = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce(m.low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(m.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT node, min(other) AS low FROM reach GROUP BY node) m ON m.node = e.vec_id""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query(
    "op7_exact_top_k",
    f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE {USABLE}
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"))
    found = identify(docs.select("doc_id", "text"), fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@query(
    "op10_warc_index",
    f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, unhex(hex)::BIT::VARCHAR AS b,
    min(page_id) OVER (PARTITION BY payload) AS first FROM p
)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('{DIGITS}', 1 + list_reduce(list_transform(range(5),
    lambda j: substr(b, 5 * i + j + 1, 1)::BIGINT), lambda x, y: 2 * x + y)::BIGINT, 1)), lambda x, y: x || y)
    AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM bits""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = write_archive(pages, shared_folder(spark, "warc"))
    return read_archive(archive, pages).drop("payload")


MIX_WEIGHTS = [3.0, 1.0, 2.0]


@query(
    "op4_source_mix",
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM d GROUP BY source
), fill AS (
  SELECT 0 AS round, source, source_size, weight, false AS capped FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, capped OR free * weight / open > 2 * source_size FROM (
    SELECT *, sum(source_size) OVER () * 1.5 - sum(CASE WHEN capped THEN source_size * 2.0 ELSE 0 END) OVER () AS free,
      sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS open FROM fill
  ) WHERE round <= (SELECT count(*) FROM s)
), last AS (
  SELECT *, sum(source_size) OVER () * 1.5 - sum(CASE WHEN capped THEN source_size * 2.0 ELSE 0 END) OVER () AS free,
    sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS open
  FROM fill WHERE round = (SELECT count(*) FROM s)
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN source_size * 2.0 ELSE free * weight / open END::DOUBLE AS target FROM last
), b AS (
  SELECT doc_id, source, unnest(range((size + 255) // 256)) AS block, size FROM d WHERE size > 0
), w AS (
  SELECT doc_id, source, least(256, size - block * 256) AS words, md5('4:' || doc_id || ':' || block) AS o, block FROM b
), c AS (
  SELECT w.doc_id, w.words, sum(w.words) OVER (PARTITION BY w.source ORDER BY o, words) - w.words AS before,
    floor(t.target / t.source_size) AS epochs, floor(t.target - floor(t.target / t.source_size) * t.source_size) AS extra
  FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT doc_id, sum(epochs * words + least(words, greatest(0, extra - before)))::BIGINT AS taken FROM c GROUP BY doc_id
)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.taken, 0) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON k.doc_id = d.doc_id""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, mix = draw_mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return taken_words(sized, mix).withColumnRenamed("id", "doc_id")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's definition."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file()).withColumnRenamed("id", "doc_id")


@query(
    "op1_ngram_jaccard",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [words] ELSE
    list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2]) END) AS set FROM w
), e AS (
  SELECT doc_id, len(set) AS n, unnest(set) AS shingle FROM s
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT a AS node, b AS other FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON r.other = l.a
)
SELECT s.doc_id, len(s.set)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT node, min(other) AS low FROM reach GROUP BY node) m ON m.node = s.doc_id""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"), size=3, num=9, den=10)


@query("op3_repeated_substrings")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=400)


@query("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), equal_chars=1)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(
    "op11_conversation_trie",
    r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS turns FROM o GROUP BY conv_id
), c AS (
  SELECT conv_id, turns, conv_id - conv_id % 5 AS origin, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(0, 8 * len(conv_id::VARCHAR)), lambda i: CASE WHEN i % 8 = 0
      THEN 256 + ascii(substr(conv_id::VARCHAR, 1 + i // 8, 1)) ELSE 0 END::BIGINT)),
    lambda x, y: CASE WHEN (xor(x, y % 256) & 1) = 1 THEN xor(xor(x, y % 256) >> 1, 3988292384::BIGINT)
      ELSE xor(x, y % 256) >> 1 END)) % 9 AS head FROM t
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.head], c.turns[c.head + 1:]) AS turns
  FROM c LEFT JOIN t b ON b.conv_id = c.origin
), p AS (
  SELECT conv_id, depth, turns[1:depth] AS path, CASE WHEN depth > 0 THEN octet_length(encode(turns[depth].text)) ELSE 0 END AS bytes,
    depth = len(turns) AS last FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r)
), n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM p GROUP BY depth, path
), k AS (
  SELECT a.depth, a.path, a.conv_id AS parent, (SELECT count(*) FROM n b WHERE b.depth = a.depth + 1 AND b.path[1:a.depth] = a.path) AS n_children
  FROM n a
), u AS (
  SELECT n.*, k.n_children FROM n JOIN k ON k.depth = n.depth AND k.path = n.path
), up AS (
  SELECT n_children, n_convs, bytes, unnest(range(0, depth + 1)) AS level, path FROM u
), s AS (
  SELECT level, path[1:level] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
  FROM up GROUP BY 1, 2
)
SELECT u.conv_id, u.depth, v.conv_id AS parent_conv_id, u.n_convs, u.n_children, s.n_leaves, s.saved_tokens, u.ends_sha256
FROM u JOIN s ON s.level = u.depth AND s.path = u.path LEFT JOIN n v ON v.depth = u.depth - 1 AND v.path = u.path[1:u.depth - 1]""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    ids, key = conversation_ids(conversations), F.col("conv_id")
    turns = materialize(numbered_turns(conversations), "turns")
    rebuilt = branched(turns, ids, F.crc32(key.cast("string").cast("binary")) % 9, key - key % 5, most=8)
    return prefix_trie(rebuilt, ids)


@query(
    "op13_decontaminate",
    r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL
), w AS (
  SELECT DISTINCT item_id, size, array_to_string(words[p:p + size - 1], ' ') AS phrase FROM (
    SELECT item_id, words, least(10, len(words)) AS size, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS p
    FROM i WHERE len(words) > 0)
), g AS (
  SELECT row, p, size, array_to_string(words[p:p + size - 1], ' ') AS phrase FROM (
    SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS p
    FROM d, (SELECT DISTINCT size FROM w) WHERE len(words) >= size)
), o AS (
  SELECT g.row, g.p, g.size, w.item_id FROM g JOIN w ON g.size = w.size AND g.phrase = w.phrase
), h AS (
  SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(p, p + size)) AS place FROM o) GROUP BY row
), t AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM o) GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.row = d.row LEFT JOIN t ON t.row = d.row""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op12_lexical_search",
    r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT count(*)::BIGINT AS n_all, sum(len(terms))::BIGINT AS l_all FROM d WHERE len(terms) > 0
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term
), w AS (
  SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), m AS (
  SELECT row, doc_id, 10 + (90 * len(terms)::BIGINT * n_all) // l_all AS m FROM d, s WHERE len(terms) > 0
), r AS (
  SELECT q.item_id, m.doc_id, m.row, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::BIGINT AS score
  FROM q JOIN p ON p.term = q.term JOIN w ON w.term = p.term JOIN m ON m.row = p.row GROUP BY q.item_id, m.doc_id, m.row
), t AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM r WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM t WHERE rank <= 10""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
