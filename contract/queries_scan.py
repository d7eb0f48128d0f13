"""Sources, projections, joins and windows of the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contract import oracle_base as O
from contract import planted as P
from contract.oracle_base import case, lit, strings
from contract.registry import Context, flat, query
from shorewatch import values as V
from shorewatch.functions import exemptions as ex
from shorewatch.functions import labels, sarif, text
from shorewatch.functions import severity as sev
from shorewatch.operators import exemptions as exops
from shorewatch.operators import listings, portfolio
from shorewatch.operators import rules as rops
from shorewatch.operators.scan import scan
from shorewatch.sources import files as sources
from shorewatch.sources.rules import RulePack, _clean

# -- corpus -----------------------------------------------------------------


@query(
    "s2_lines",
    O.with_steps(
        f"""SELECT source, file, CAST(line_no AS BIGINT) AS line_no, line, {O.nonblank("line")} AS has_text
            FROM ({O.lines_of("corpus")})""",
        O.CORPUS,
    ),
)
def s2_lines(c: Context) -> DataFrame:
    return c.corpus.select("source", "file", F.posexplode(text.lines(F.col("content"))).alias("pos", "line")).select(
        "source",
        "file",
        (F.col("pos") + 1).cast("bigint").alias("line_no"),
        "line",
        (~text.is_blank(F.col("line"))).alias("has_text"),
    )


_TEXTS = """texts AS (
  SELECT coalesce(source, '') AS source, coalesce(lang, '') || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS file,
         coalesce("text", '') AS content FROM documents
  UNION ALL SELECT regexp_extract(coalesce(url, ''), '^[a-z]+://([^/]*)', 1), CAST(page_id AS VARCHAR) || '.html',
         coalesce(html, '') FROM pages
  UNION ALL SELECT coalesce(role, ''), CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.chat',
         coalesce("text", '') FROM conversations)"""

_TEXT_RULES = [
    ("license-line", r"(?i)\blicen[cs]e\b", "", "INFO"),
    ("mail-address", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}", "", "LOW"),
    ("token-word", r"\btoken\b", "", "MEDIUM"),
    ("comma-end", r",\s*$", "chat", "INFO"),
    ("script-element", r"<script\b[^>]*>", "html", "MEDIUM"),
    ("first-capital", r"^[[:upper:]]\w+ \w+\.$", "text", "INFO"),
]


def text_corpus(c: Context) -> DataFrame:
    docs = sources.files_from_table(
        c.table("documents"),
        F.col("source"),
        F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")),
        F.col("text"),
    )
    pages = sources.files_from_table(
        c.table("pages"),
        F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]+://([^/]*)", 1),
        F.concat(F.col("page_id").cast("string"), F.lit(".html")),
        F.col("html"),
    )
    chats = sources.files_from_table(
        c.table("conversations"),
        F.col("role"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".chat")),
        F.col("text"),
    )
    return sources.spread(docs.unionAll(pages).unionAll(chats))


def text_pack() -> RulePack:
    extensions = {"text": [".txt"], "html": [".html"], "chat": [".chat"]}
    openers = [
        {"id": f"lang-{g}", "language": g, "extensions": e, "pattern": r"\x{10FFFF}", "severity": "INFO"}
        for g, e in extensions.items()
    ]
    rules = [{"id": i, "pattern": p, "language": g, "severity": s, "algorithm": i} for i, p, g, s in _TEXT_RULES]
    return RulePack(
        _clean({"quantum_threat": "unknown", "primitive": "other", "message": "", "migration": "", **r})
        for r in [*openers, *rules]
    )


_TEXT_LANG = {".txt": "text", ".html": "html", ".chat": "chat"}


@query(
    "s2_text_corpus_scan",
    f"WITH {_TEXTS}, tl AS ({O.lines_of('texts')}), rules AS (SELECT * FROM (VALUES "
    + ", ".join(f"({lit(i)}, {lit(g)}, {lit(s)})" for i, _, g, s in _TEXT_RULES)
    + """) AS v(rule_id, language, severity))
    SELECT l.source, l.file, r.rule_id, CAST(l.line_no AS BIGINT) AS line, r.severity, sha256(l.line) AS line_hash
    FROM tl l JOIN rules r ON (r.language = '' OR r.language = """
    + case("regexp_extract(l.file, '(\\.[^./]*)$', 1)", _TEXT_LANG, "''")
    + ") AND CASE r.rule_id "
    + " ".join(f"WHEN {lit(i)} THEN regexp_matches(l.line, {lit(p)})" for i, p, _, _ in _TEXT_RULES)
    + " END",
)
def s2_text_corpus_scan(c: Context) -> DataFrame:
    from shorewatch.operators.scan import match_rules, select_files

    pack = text_pack()
    return match_rules(select_files(text_corpus(c), pack), pack).select(
        "source",
        "file",
        "rule_id",
        (F.col("pos") + 1).cast("bigint").alias("line"),
        "severity",
        F.sha2("text", 256).alias("line_hash"),
    )


#: A pack of generated rules: three syllables each, in four forms of pattern.
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar".split()
_LARGE, _STEP = 2000, 7919
_FORMS = [r"\b{}\b", r"{}\w*e", r"(?i){}[.,]", r"\b{}\s+\w+\.$"]


def large_pack() -> RulePack:
    """2,000 patterns on one language."""
    n = len(_SYLLABLES)
    rules = [{"id": "lang-text", "language": "text", "extensions": [".txt"], "pattern": r"\x{10FFFF}", "severity": "INFO"}]
    for i in range(_LARGE):
        at = i * _STEP % n**3
        word = _SYLLABLES[at // n**2] + _SYLLABLES[at // n % n] + _SYLLABLES[at % n]
        rules.append({"id": f"large-{i}", "language": "text", "pattern": _FORMS[i % 4].format(word), "severity": "INFO"})
    return RulePack(_clean({"quantum_threat": "unknown", "primitive": "other", **r}) for r in rules)


@query(
    "p3_large_pack",
    f"""WITH texts AS (
      SELECT coalesce(source, '') AS source, CAST(doc_id AS VARCHAR) || '.txt' AS file, coalesce("text", '') AS content FROM documents
    ), syllables AS (SELECT {strings(_SYLLABLES)} AS s), rules AS (
      SELECT i, s[1 + k // {len(_SYLLABLES) ** 2}] || s[1 + k // {len(_SYLLABLES)} % {len(_SYLLABLES)}] || s[1 + k % {len(_SYLLABLES)}] AS word
      FROM (SELECT i, i * {_STEP} % {len(_SYLLABLES) ** 3} AS k FROM range({_LARGE}) AS r(i)), syllables
    ), l AS ({O.lines_of("texts")}), near AS MATERIALIZED (
      SELECT DISTINCT source, file, line_no, line, i, word FROM (
        SELECT l.*, unnest(range(1, length(lower(line)) - 4)) AS p FROM l) g
      JOIN rules r ON substr(lower(g.line), g.p, 6) = r.word
    )
    SELECT source, file, 'large-' || CAST(i AS VARCHAR) AS rule_id, CAST(line_no AS BIGINT) AS line FROM near
    WHERE CASE i % 4 """
    + " ".join(f"WHEN {k} THEN regexp_matches(line, {' || word || '.join(lit(x) for x in form.split('{}'))})" for k, form in enumerate(_FORMS))
    + " END",
)
def p3_large_pack(c: Context) -> DataFrame:
    """All documents against a pack whose size does not show in the cost of a file without matches."""
    from shorewatch.operators.scan import match_rules, select_files

    pack, texts = large_pack(), c.table("documents")
    files = sources.files_from_table(texts, F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"))
    line = (F.col("pos") + 1).cast("bigint").alias("line")
    return match_rules(select_files(sources.spread(files), pack), pack).select("source", "file", "rule_id", line)


@query(
    "p1_detect_language",
    O.from_corpus(
        f"""SELECT source, file, lower(regexp_extract(file, '(\\.[^./]*)$', 1)) AS ext,
            {case("lower(regexp_extract(file, '(\\.[^./]*)$', 1))", V.EXTENSIONS, "'unknown'")} AS lang FROM corpus"""
    ),
)
def p1_detect_language(c: Context) -> DataFrame:
    ext = text.extension(F.col("file"))
    return c.corpus.select(
        "source", "file", ext.alias("ext"), sev.choose(ext, V.EXTENSIONS, F.lit("unknown")).alias("lang")
    )


@query(
    "p2_skip_directories",
    O.from_corpus(
        f"""SELECT source, count(*) AS files,
              count(*) FILTER (list_has_any(string_split(file, '/')[:-2], {strings(V.SKIPPED_DIRECTORIES)})) AS skipped
            FROM corpus GROUP BY source"""
    ),
)
def p2_skip_directories(c: Context) -> DataFrame:
    return c.corpus.groupBy("source").agg(
        F.count("*").alias("files"), F.count_if(text.in_skipped_directory(F.col("file"))).alias("skipped")
    )


@query("j2_extension_join", O.from_selected("SELECT source, file, lang FROM selected"))
def j2_extension_join(c: Context) -> DataFrame:
    return c.selected.select("source", "file", "lang")


# -- matching ----------------------------------------------------------------


@query(
    "j1_line_rule_match",
    O.from_matches("SELECT source, file, rule_id, CAST(line AS BIGINT) AS line FROM matches"),
)
def j1_line_rule_match(c: Context) -> DataFrame:
    return c.matches.select("source", "file", "rule_id", (F.col("pos") + 1).cast("bigint").alias("line"))


@query(
    "p3_rule_predicate",
    O.with_steps(
        """SELECT r.rule_id, count(*) AS lines FROM selected_lines l
           JOIN rule_langs r ON l.lang = r.lang AND """
        + O.rule_match("l.line")
        + " GROUP BY 1",
        O.CORPUS,
        O.SELECTED,
        f"selected_lines AS ({O.lines_of('selected', 'source, file, lang')})",
        O.RULES,
        "rule_langs AS (SELECT r.*, l.lang FROM rules r JOIN (SELECT DISTINCT lang FROM ext_map) l"
        " ON r.language = '' OR r.language = l.lang)",
    ),
)
def p3_rule_predicate(c: Context) -> DataFrame:
    return c.matches.groupBy("rule_id").agg(F.count("*").alias("lines"))


@query(
    "s4_bundled_rules",
    O.from_matches(
        """SELECT r.rule_ord + 0 AS ord, r.rule_id, r.algorithm, r.severity, r.quantum_threat, r.primitive,
                  count(m.line) AS hits
           FROM rules r LEFT JOIN matches m ON r.rule_id = m.rule_id GROUP BY ALL"""
    ).replace("r.rule_ord + 0", "CAST(r.rule_ord AS BIGINT)"),
)
def s4_bundled_rules(c: Context) -> DataFrame:
    hits = c.matches.groupBy("rule_id").agg(F.count("*").alias("hits"))
    return (
        c.pack.frame(c.spark)
        .select(F.col("ord").cast("bigint"), F.col("id").alias("rule_id"), "algorithm", "severity", "quantum_threat", "primitive")
        .join(hits, "rule_id", "left")
        .withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint")))
    )


@query(
    "p7_snippet",
    O.from_matches("SELECT source, file, rule_id, CAST(line AS BIGINT) AS line, sha256(snippet) AS snippet FROM matches"),
)
def p7_snippet(c: Context) -> DataFrame:
    line = F.col("pos") + 1
    return c.matches.select(
        "source",
        "file",
        "rule_id",
        line.cast("bigint").alias("line"),
        F.sha2("snippet", 256).alias("snippet"),
    )


@query(
    "p24_findings",
    O.from_findings("""SELECT * REPLACE (CAST(rule_ord AS BIGINT) AS rule_ord, CAST(line AS BIGINT) AS line,
        CAST("column" AS BIGINT) AS "column", CAST(confidence AS BIGINT) AS confidence) FROM findings"""),
)
def p24_findings(c: Context) -> DataFrame:
    numbers = {n: F.col(n).cast("bigint") for n in ("rule_ord", "line", "column", "confidence")}
    return flat(c.findings).withColumns(numbers)


@query(
    "p11_fingerprint",
    O.from_matches(
        f"""SELECT source, file, CAST(line AS BIGINT) AS line, rule_id,
              sha256(rule_id || '|' || file || '|' ||
                     trim(regexp_replace(snippet, {lit("[" + V.SPACE_CLASS + "]+")}, ' ', 'g'))) AS fingerprint
            FROM matches"""
    ),
)
def p11_fingerprint(c: Context) -> DataFrame:
    return listings.with_fingerprint(c.inline).select(
        "source", "file", F.col("line").cast("bigint"), "rule_id", "fingerprint"
    )


# -- exemptions ----------------------------------------------------------------


@query(
    "p8_annotation_parse",
    O.with_steps(
        f"""SELECT rule_id, reason, until, count(*) AS lines FROM (
              SELECT regexp_extract(line, {lit(V.ANNOTATION_RULE_PATTERN)}, 1) AS rule_id,
                     coalesce(nullif({O._REASON[0]}, ''), nullif({O._REASON[1]}, ''), {O._REASON[2]}) AS reason,
                     regexp_extract(line, {lit(V.ANNOTATION_UNTIL_PATTERN)}, 1) AS until
              FROM ({O.lines_of("corpus")}) WHERE regexp_matches(line, {lit(V.MARKER_PATTERN)}))
            WHERE {O.nonblank("reason")} GROUP BY ALL""",
        O.CORPUS,
    ),
)
def p8_annotation_parse(c: Context) -> DataFrame:
    lines = (
        c.corpus.where(F.contains("content", F.lit(V.MARKER)))
        .select(F.explode(text.lines(F.col("content"))).alias("line"))
        .where(ex.has_marker(F.col("line")))
    )
    return (
        lines.select(ex.annotation(F.col("line")).alias("note"))
        .where(F.col("note").isNotNull())
        .groupBy(F.col("note.rule").alias("rule_id"), F.col("note.reason").alias("reason"), F.col("note.until").alias("until"))
        .agg(F.count("*").alias("lines"))
    )


@query(
    "w1_annotation_targets",
    O.with_steps(
        """SELECT source, file, CAST(line_no AS BIGINT) AS line, CAST(target_line AS BIGINT) AS target_line,
                  rule_id, reason, until FROM notes""",
        O.CORPUS,
        f"all_lines AS ({O.lines_of('corpus')})",
        f"notes AS ({O.notes_of('all_lines')})",
    ),
)
def w1_annotation_targets(c: Context) -> DataFrame:
    return exops.annotations(c.corpus).withColumns({n: F.col(n).cast("bigint") for n in ("line", "target_line")})


_INLINE_SQL = O.from_inline(
    """SELECT source, file, rule_id, CAST(line AS BIGINT) AS line, status, ex_reason, ex_until, ex_source
       FROM inline_findings"""
)


def _inline_columns(findings: DataFrame) -> DataFrame:
    return flat(findings).select(
        "source", "file", "rule_id", F.col("line").cast("bigint"), "status", "ex_reason", "ex_until", "ex_source"
    )


@query("j4_inline_exemptions", _INLINE_SQL)
def j4_inline_exemptions(c: Context) -> DataFrame:
    return _inline_columns(c.inline)


@query("j4_inline_exemptions_joined", _INLINE_SQL)
def j4_inline_exemptions_joined(c: Context) -> DataFrame:
    """Same through tables: findings without annotations joined to the annotation table."""
    plain = c.inline.withColumns(
        {"status": F.lit(V.ACTIVE), "exemption": F.lit(None).cast(c.inline.schema["exemption"].dataType)}
    )
    return _inline_columns(exops.apply_annotations(plain, exops.annotations(c.corpus), c.as_of))


_GLOB_CASES = {
    "": "",
    "**": r"^.*$",
    "**/*.java": r"^(.*/)?[^/]*\.java$",
    "src/**": r"^src(/.*)?$",
    "src/**/vault/**": r"^src/(.*/)?vault(/.*)?$",
    "a/*": r"^a/[^/]*$",
    "a/?": r"^a/[^/]$",
    "*/F??_*": r"^[^/]*/F[^/][^/]_[^/]*$",
    "**/F1*.{go,py}": r"^(.*/)?F1[^/]*\.\{go,py\}$",
    "/a/**": r"^\x{10FFFF}$",
    "services/**x/*": r"^services/[^/]*x/[^/]*$",
    "**/build.d/**/F[0-9]*": r"^(.*/)?build\.d/(.*/)?F\[0-9\][^/]*$",
}


@query(
    "p9_glob_match",
    O.from_corpus(
        "SELECT source, "
        + ", ".join(f"count(*) FILTER (regexp_matches(file, {lit(r)})) AS g{i}" for i, r in enumerate(_GLOB_CASES.values()))
        + " FROM corpus GROUP BY source"
    ),
)
def p9_glob_match(c: Context) -> DataFrame:
    counts = [
        F.count_if(ex.glob_matches(ex.glob_regex(F.lit(g)), F.col("file"))).alias(f"g{i}")
        for i, g in enumerate(_GLOB_CASES)
    ]
    return c.corpus.groupBy("source").agg(*counts)


@query(
    "p10_expiry",
    O.with_steps(
        f"""SELECT source, CAST(ord AS BIGINT) AS ord, until, {O.status_of("until")} AS status FROM entries""",
        O.EXEMPTIONS,
    ),
)
def p10_expiry(c: Context) -> DataFrame:
    return c.exemptions.select(
        "source", F.col("ord").cast("bigint"), "until", ex.exempted_status(F.col("until"), c.as_of).alias("status")
    )


@query(
    "s5_config_exemptions",
    O.with_steps(
        "SELECT source, CAST(ord AS BIGINT) AS ord, rule, reason, owner, until FROM valid_entries", O.EXEMPTIONS
    ),
)
def s5_config_exemptions(c: Context) -> DataFrame:
    return exops.valid_exemptions(c.exemptions).select(
        "source", F.col("ord").cast("bigint").alias("ord"), "rule", "reason", "owner", "until"
    )


_CONFIG_SQL = O.from_findings(
    """SELECT source, file, rule_id, CAST(line AS BIGINT) AS line, status, ex_reason, ex_owner, ex_until, ex_source
       FROM findings"""
)


def _config_columns(findings: DataFrame) -> DataFrame:
    return flat(findings).select(
        "source",
        "file",
        "rule_id",
        F.col("line").cast("bigint"),
        "status",
        "ex_reason",
        "ex_owner",
        "ex_until",
        "ex_source",
    )


@query("j5_config_exemptions", _CONFIG_SQL)
def j5_config_exemptions(c: Context) -> DataFrame:
    return _config_columns(c.findings)


@query("j5_config_exemptions_salted", _CONFIG_SQL)
def j5_config_exemptions_salted(c: Context) -> DataFrame:
    """The form for exemption tables too large for every task."""
    return _config_columns(scan(c.corpus, c.pack, c.as_of, c.exemptions, collect_bytes=0))


@query(
    "w7_first_exemption",
    O.from_inline(
        f"""SELECT source, ord, count(*) AS findings FROM (
              SELECT i.source, CAST(e.ord AS BIGINT) AS ord,
                     row_number() OVER (PARTITION BY i.source, i.file, i.rule_ord, i.line ORDER BY e.ord) AS nth
              FROM inline_findings i JOIN valid_entries e ON i.source = e.source
               AND (e.rule = '' OR e.rule = i.rule_id) AND {O._GLOB} WHERE i.status = 'active')
            WHERE nth = 1 GROUP BY ALL"""
    ).replace("\nSELECT source, ord", f",{O.EXEMPTIONS}\nSELECT source, ord"),
)
def w7_first_exemption(c: Context) -> DataFrame:
    """How often each configured entry is the deciding one."""
    order = {reason: i for i, (_, _, _, _, reason, _, _) in enumerate(P.EXEMPTION_ENTRIES)}
    decided = c.findings.where(F.col("exemption.source") == "config")
    return decided.groupBy(
        "source", sev.choose(F.col("exemption.reason"), order, F.lit(-1)).cast("bigint").alias("ord")
    ).agg(F.count("*").alias("findings"))


# -- rule tables ---------------------------------------------------------------

# A rule table derived from ``part``: four layers, repeated ids, bad and empty values.
_THREATS = [*V.THREATS, "", "quantum"]
_PRIMITIVES = [*V.PRIMITIVES, "", "cipher"]
_SEVERITIES = ["", "", "HIGH", "SAFE", "URGENT"]
_EXTS = [".rb", ".RAKE", "rs", ".rs", ".py", ".Kt", ".kts", ".swift", ".JAVA", ".php", ".c"]
_LANGS = ["ruby", "rust", "", "kotlin", "swift", "php", "c"]


def rule_table(c: Context) -> DataFrame:
    p = F.col("p_partkey")

    def pick(names, at):
        return F.get(F.array(*[F.lit(n) for n in names]), (at % len(names)).cast("int"))

    third = F.when(p % 3 == 0, F.lit("rule-0")).when(p % 29 == 1, F.lit("")).otherwise(
        F.concat(F.lit("rule-"), (p % 97).cast("string"))
    )
    return P.read(c.spark, c.sf_dir, "part").select(
        (p % 4).cast("int").alias("layer"),
        F.concat(F.lit("f"), (p % 5).cast("string"), F.lit(".yaml")).alias("file"),
        p.cast("int").alias("pos"),
        third.alias("id"),
        pick(_LANGS, p).alias("language"),
        F.array(pick(_EXTS, p), pick(_EXTS, p + F.lit(3) * (p % 2))).alias("extensions"),
        F.concat(F.lit("p"), p.cast("string")).alias("pattern"),
        pick(_SEVERITIES, p).alias("severity"),
        pick(_THREATS, p).alias("quantum_threat"),
        pick(_PRIMITIVES, p + 7 * (p % 11)).alias("primitive"),
    )


def _sql_pick(names, at: str) -> str:
    return f"{strings(names)}[1 + ({at}) % {len(names)}]"


_RULE_TABLE = f"""rule_table AS (
  SELECT p_partkey % 4 AS layer, 'f' || CAST(p_partkey % 5 AS VARCHAR) || '.yaml' AS file, p_partkey AS pos,
         CASE WHEN p_partkey % 3 = 0 THEN 'rule-0' WHEN p_partkey % 29 = 1 THEN ''
              ELSE 'rule-' || CAST(p_partkey % 97 AS VARCHAR) END AS id,
         {_sql_pick(_LANGS, "p_partkey")} AS language,
         [{_sql_pick(_EXTS, "p_partkey")}, {_sql_pick(_EXTS, "p_partkey + 3 * (p_partkey % 2)")}] AS extensions,
         'p' || CAST(p_partkey AS VARCHAR) AS pattern,
         {_sql_pick(_SEVERITIES, "p_partkey")} AS severity,
         {_sql_pick(_THREATS, "p_partkey")} AS quantum_threat,
         {_sql_pick(_PRIMITIVES, "p_partkey + 7 * (p_partkey % 11)")} AS primitive
  FROM part)"""

_DERIVED = O.DERIVED_SEVERITY


@query(
    "p4_derive_severity",
    f"WITH {_RULE_TABLE} SELECT pattern, quantum_threat, primitive, {_DERIVED} AS severity FROM rule_table",
)
def p4_derive_severity(c: Context) -> DataFrame:
    return rops.resolve_severity(rule_table(c)).select("pattern", "quantum_threat", "primitive", "severity")


@query(
    "p5_severity_rank",
    f"""WITH {_RULE_TABLE}, s AS (SELECT pattern, {_DERIVED} AS severity FROM rule_table)
        SELECT pattern, severity, CAST({case("severity", V.SEVERITY_RANK, "0")} AS BIGINT) AS severity_rank,
               CAST({case("severity", V.LISTING_RANK, "4")} AS BIGINT) AS listing_rank FROM s""",
)
def p5_severity_rank(c: Context) -> DataFrame:
    s = F.col("severity")
    return rops.resolve_severity(rule_table(c)).select(
        "pattern",
        "severity",
        sev.rank(s).cast("bigint").alias("severity_rank"),
        sev.listing_rank(s).cast("bigint").alias("listing_rank"),
    )


def _in(names) -> str:
    return "(" + ", ".join(lit(n) for n in names) + ")"


#: Patterns that compile, and then those that do not: unbalanced, repeated twice, referring back, looking ahead.
_COMPILING = [r"a+b", r"(?i)x{2,3}", r"[[:alpha:]_]\w*", r"^key\.(new|open)\($", r"\x{1F600}|é"]
_REFUSED = ["(a", "a**", "[z", r"(x)\1", "(?=x)y", "b)", "x{2,1}", r"\q"]
_SPELLED = [*_COMPILING, *_REFUSED]


@query(
    "p6_rule_validation",
    f"""WITH {_RULE_TABLE.replace("'p' || CAST(p_partkey AS VARCHAR) AS pattern", _sql_pick(_SPELLED, "p_partkey // 3") + " AS pattern")}
        SELECT pattern, id, CASE
            WHEN pattern IN {_in(_REFUSED)} THEN 'invalid pattern'
            WHEN quantum_threat = '' THEN 'quantum_threat is required'
            WHEN quantum_threat NOT IN {_in(V.THREATS)} THEN 'invalid quantum_threat'
            WHEN primitive = '' THEN 'primitive is required'
            WHEN primitive NOT IN {_in(V.PRIMITIVES)} THEN 'invalid primitive' END AS error,
          id = '' AS missing_id, severity <> '' AND severity NOT IN {_in(V.SEVERITIES)} AS unlisted_severity
        FROM rule_table""",
)
def p6_rule_validation(c: Context) -> DataFrame:
    number = F.call_function("div", F.substring("pattern", 2, 20).cast("bigint"), F.lit(3)) % len(_SPELLED)
    spelled = F.get(F.array(*[F.lit(p) for p in _SPELLED]), number.cast("int"))
    checked = rops.check_rules(rule_table(c).withColumn("pattern", spelled))
    return checked.select("pattern", "id", "error", "missing_id", "unlisted_severity")


@query(
    "j3_extension_map",
    f"""WITH {_RULE_TABLE}, e AS (
          SELECT layer, pos, language, unnest(extensions) AS ext, generate_subscripts(extensions, 1) AS nth
          FROM rule_table WHERE language <> ''),
        d AS (SELECT lower(ext) AS ext, arg_max(language, (pos, nth)) AS lang FROM e
              WHERE starts_with(ext, '.') AND lower(ext) NOT IN {_in(V.EXTENSIONS)} GROUP BY 1)
        SELECT ext, lang FROM d UNION ALL
        SELECT * FROM (VALUES {", ".join(f"({lit(e)}, {lit(g)})" for e, g in V.EXTENSIONS.items())}) AS v(ext, lang)""",
)
def j3_extension_map(c: Context) -> DataFrame:
    return rops.extension_table(rule_table(c).withColumnRenamed("pos", "ord"))


_MERGED = f"""WITH {_RULE_TABLE}, r AS (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY layer DESC, file DESC, pos DESC) AS last,
             first_value((layer, file, pos)) OVER (PARTITION BY id ORDER BY layer, file, pos) AS place
      FROM rule_table)"""


@query(
    "w6_rule_override",
    f"{_MERGED} SELECT CAST(place[1] AS BIGINT) AS layer, place[2] AS file, CAST(place[3] AS BIGINT) AS pos, id,"
    " language, pattern, severity, quantum_threat, primitive FROM r WHERE last = 1",
)
def w6_rule_override(c: Context) -> DataFrame:
    return rops.merge_layers(rule_table(c)).select(
        F.col("layer").cast("bigint"),
        "file",
        F.col("pos").cast("bigint"),
        "id",
        "language",
        "pattern",
        "severity",
        "quantum_threat",
        "primitive",
    )


@query(
    "u1_layer_union",
    f"""{_MERGED}, d AS (SELECT id, count(*) AS definitions, count(DISTINCT layer) AS layers FROM rule_table GROUP BY id)
        SELECT CAST(place[1] AS BIGINT) AS layer, r.id, pattern, severity, definitions, layers
        FROM r JOIN d ON d.id = r.id WHERE last = 1""",
)
def u1_layer_union(c: Context) -> DataFrame:
    """Layers arrive as tables of their own, without a layer column, and are numbered, unioned and merged."""
    rules = rule_table(c)
    layers = [rules.where(F.col("layer") == n).drop("layer") for n in range(4)]
    union = reduce(DataFrame.unionByName, (t.withColumn("layer", F.lit(n)) for n, t in enumerate(layers)))
    counts = union.groupBy("id").agg(F.count("*").alias("definitions"), F.countDistinct("layer").alias("layers"))
    merged = rops.merge_layers(union).select(F.col("layer").cast("bigint"), "id", "pattern", "severity")
    return merged.join(counts, "id").select("layer", "id", "pattern", "severity", "definitions", "layers")


# -- labels and report scalars ---------------------------------------------------


@query(
    "p12_levels",
    O.from_findings(
        f"""SELECT severity, {case("severity", V.SARIF_LEVEL, "'note'")} AS sarif_level,
              {case("severity", V.CI_LEVEL, "'notice'")} AS ci_level, count(*) AS findings
            FROM findings GROUP BY ALL"""
    ),
)
def p12_levels(c: Context) -> DataFrame:
    s = F.col("severity")
    return c.findings.groupBy(s, sev.sarif_level(s).alias("sarif_level"), sev.ci_level(s).alias("ci_level")).agg(
        F.count("*").alias("findings")
    )


@query(
    "p13_tags_and_suppressions",
    O.from_findings(
        """SELECT 'security,cryptography,post-quantum,' || quantum_threat || ',' || primitive AS tags,
              CASE WHEN ex_source = 'config' THEN 'external' WHEN ex_source IS NOT NULL THEN 'inSource' END AS kind,
              CASE WHEN ex_source IS NULL THEN NULL WHEN status = 'expired-exemption' THEN 'rejected'
                   ELSE 'accepted' END AS suppression, CAST(greatest("column", 1) AS BIGINT) AS start_column,
              count(*) AS findings FROM findings GROUP BY ALL"""
    ),
)
def p13_tags_and_suppressions(c: Context) -> DataFrame:
    origin = F.col("exemption.source")
    return c.findings.groupBy(
        F.array_join(sarif.rule_tags(F.col("quantum_threat"), F.col("primitive")), ",").alias("tags"),
        F.when(origin.isNotNull(), sarif.suppression_kind(origin)).alias("kind"),
        F.when(origin.isNotNull(), sarif.suppression_status(F.col("status"))).alias("suppression"),
        sarif.at_least_one(F.col("column")).cast("bigint").alias("start_column"),
    ).agg(F.count("*").alias("findings"))


@query(
    "p15_short_path",
    O.from_corpus(
        """SELECT source, file, CASE WHEN len(string_split(file, '/')) > 3
              THEN array_to_string(string_split(file, '/')[-3:], '/') ELSE file END AS short,
              string_split(file, '/')[-1] AS base FROM corpus"""
    ),
)
def p15_short_path(c: Context) -> DataFrame:
    f = F.col("file")
    return c.corpus.select("source", "file", text.short_path(f).alias("short"), text.base_name(f).alias("base"))


@query(
    "p16_labels",
    O.from_findings(
        f"""SELECT quantum_threat, severity, {case("quantum_threat", V.THREAT_LABELS, "quantum_threat")} AS threat_label,
              {case("severity", V.SEVERITY_CLASSES, "'sev-info'")} AS severity_class,
              CASE WHEN source = '' THEN 'local scan' ELSE source END AS source_label, count(*) AS findings
            FROM findings GROUP BY ALL"""
    ),
)
def p16_labels(c: Context) -> DataFrame:
    return c.findings.groupBy(
        "quantum_threat",
        "severity",
        labels.threat_label(F.col("quantum_threat")).alias("threat_label"),
        labels.severity_class(F.col("severity")).alias("severity_class"),
        labels.source_label(F.col("source")).alias("source_label"),
    ).agg(F.count("*").alias("findings"))


@query(
    "p17_slug",
    O.with_steps("SELECT repo, replace(repo, '/', '-') AS slug FROM targets", O.TARGETS),
)
def p17_slug(c: Context) -> DataFrame:
    return c.targets.select("repo", text.slug(F.col("repo")).alias("slug"))


_ONLY = ["acme-monorepo", "org1-repo-1", "org2-repo-2", "nobody-nothing"]


@query(
    "j7_target_subset",
    O.with_steps(
        f"SELECT repo, name FROM targets WHERE replace(repo, '/', '-') IN {_in(_ONLY)}", O.TARGETS
    ),
)
def j7_target_subset(c: Context) -> DataFrame:
    return portfolio.select_targets(c.targets, _ONLY).select("repo", "name")


@query(
    "j7_target_semi_join",
    O.with_steps(
        f"""SELECT repo, replace(repo, '/', '-') AS slug FROM targets WHERE replace(repo, '/', '-') IN (
              SELECT replace({O.SOURCE.format(k="l_suppkey")}, '/', '-') FROM lineitem
              WHERE l_quantity > 45 AND l_discount >= 0.1 AND l_tax >= 0.08)""",
        O.TARGETS,
    ),
)
def j7_target_semi_join(c: Context) -> DataFrame:
    wanted = (
        c.table("lineitem")
        .where((F.col("l_quantity") > 45) & (F.col("l_discount") >= 0.1) & (F.col("l_tax") >= 0.08))
        .select(text.slug(P.source_of(F.col("l_suppkey"))).alias("slug"))
        .distinct()
    )
    return portfolio.join_selected(c.targets, wanted).select("repo", "slug")
