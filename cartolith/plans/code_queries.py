"""Queries of lexical state, token patterns, nested blocks and scopes, with the texts' own signs as quotes, comments and brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config
from ..operators import blocks, hooks, lexing, references
from ..storage import written
from . import bindings as b
from .registry import query

LANGUAGES = ("en", "fr", "de", "es")
REGIONS = {language: (lexing.Region("comment", "#"), lexing.Region("string", '"', '"')) for language in LANGUAGES}
STYLES = dict.fromkeys(LANGUAGES, ("%", "*"))
STOPS = dict.fromkeys(LANGUAGES, ("the", "of", "la", "en"))
PATTERNS = [
    lexing.Pattern(language, role, name, left, right)
    for language in LANGUAGES
    for role, name, left, right in (
        ("skip", "shouted", ("!",), ()),
        ("reference", "between", (",",), (",",)),
        ("reference", "after_the", ("of", "the"), ()),
        ("reference", "listed", (".", "%{", "%word", ",", "%}*"), ()),
        ("reference", "last", (), (".",)),
    )
]


def files(spark: SparkSession, d: str) -> DataFrame:
    return b.files(spark, d).withColumn("language", F.col("lang"))


@query(
    "r1_lexical_kinds",
    rf"""WITH {b.FILES}, pieces AS (SELECT path, unnest(regexp_extract_all(content, '"[^"\n]*"?|#[^\n]*|[^"#]+')) AS p FROM files)
SELECT path, CASE left(p, 1) WHEN '"' THEN 'string' WHEN '#' THEN 'comment' ELSE 'code' END AS kind, CAST(sum(len(regexp_extract_all(p, '[A-Za-z_]+'))) AS BIGINT) AS words
FROM pieces GROUP BY 1, 2 HAVING sum(len(regexp_extract_all(p, '[A-Za-z_]+'))) > 0""",
)
def r1_kinds(spark: SparkSession, d: str) -> DataFrame:
    return lexing.lexed_words(files(spark, d), REGIONS).groupBy("path", "kind").agg(F.count("*").alias("words"))


_TOKENS = rf"""{b.FILES}, lines AS (
  SELECT path, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS line, unnest(t) AS text FROM (SELECT path, string_split(content, chr(10)) AS t FROM files)),
tokens AS MATERIALIZED (
  SELECT path, line, generate_subscripts(t, 1) AS k, unnest(t) AS tok
  FROM (SELECT path, line, regexp_extract_all(regexp_replace(text, '"[^"]*"?|#.*', ' ', 'g'), '[A-Za-z0-9_]+|[^ \t\v\f\rA-Za-z0-9_]') AS t FROM lines)),
near AS (
  SELECT *, lag(tok) OVER w AS a, lag(tok, 2) OVER w AS aa, lead(tok) OVER w AS z, regexp_matches(tok, '^[A-Za-z_]') AND tok NOT IN ('the', 'of', 'la', 'en') AS word,
         count(*) FILTER (tok = '.') OVER w AS g FROM tokens WINDOW w AS (PARTITION BY path, line ORDER BY k)),
runs AS (SELECT *, row_number() OVER (PARTITION BY path, line, g ORDER BY k) - 1 AS j FROM near),
marked AS (
  SELECT *, coalesce(sum(CASE WHEN j = 0 OR (j % 2 = 1 AND word) OR (j % 2 = 0 AND tok = ',') THEN 0 ELSE 1 END)
                     OVER (PARTITION BY path, line, g ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad FROM runs),
found AS (
  SELECT path, line, tok AS text, CASE WHEN a = '!' THEN NULL WHEN a = ',' AND z = ',' THEN 'between' WHEN aa = 'of' AND a = 'the' THEN 'after_the'
                                       WHEN g > 0 AND j % 2 = 1 AND bad = 0 THEN 'listed' WHEN z = '.' THEN 'last' END AS pattern
  FROM marked WHERE word)"""


@query("r2_token_patterns", f"WITH {_TOKENS} SELECT path, line, text, pattern, count(*) AS n FROM found WHERE pattern IS NOT NULL GROUP BY ALL")
def r2_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Names by what stands before and after them in their line, comments and strings left out."""
    found = lexing.matched_references(files(spark, d), lexing.pattern_table(spark, PATTERNS, STOPS), REGIONS, within="line")
    return found.groupBy("path", "line", "text", "pattern").agg(F.count("*").alias("n"))


BLOCKS = rf"""{b.LEAVES}, marks AS (
  SELECT path, pos, c FROM (SELECT path, generate_subscripts(s, 1) AS pos, unnest(s) AS c FROM (SELECT path, string_split(content, '') AS s FROM files)) WHERE c IN ('%', '*')),
sums AS (SELECT *, sum(CASE c WHEN '%' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY pos) AS p FROM marks),
deep AS (SELECT *, p - least(0, min(p) OVER (PARTITION BY path ORDER BY pos)) AS d FROM sums),
levels AS MATERIALIZED (
  SELECT *, CASE c WHEN '%' THEN d ELSE lag(d, 1, 0) OVER w END AS l, c = '%' OR lag(d, 1, 0) OVER w > d AS used FROM deep WINDOW w AS (PARTITION BY path ORDER BY pos)),
pairs AS (SELECT path, pos, c, l, lead(pos) OVER (PARTITION BY path, l ORDER BY pos) AS close FROM levels WHERE used),
opened AS MATERIALIZED (
  SELECT p.path, pos, coalesce(close, length(content)) AS stop, l, row_number() OVER (PARTITION BY p.path ORDER BY pos) AS block, content FROM pairs p JOIN files f ON p.path = f.path WHERE c = '%'),
blocks AS MATERIALIZED (
  SELECT o.path, o.pos, o.stop, o.l, o.block, o.content, coalesce(u.block, 0) AS parent, z.block AS last
  FROM opened o ASOF LEFT JOIN opened u ON o.path = u.path AND o.l - 1 = u.l AND o.pos > u.pos ASOF JOIN opened z ON o.path = z.path AND o.stop >= z.pos),
begun AS (SELECT path, line, coalesce(sum(length(text) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines),
spots AS MATERIALIZED (SELECT w.path, w.line, w.col, w.end_col, w.text, s.start + w.col + 1 AS pos FROM leaves w JOIN begun s ON w.path = s.path AND w.line = s.line),
held AS (SELECT s.*, coalesce(m.d, 0) AS d FROM spots s ASOF LEFT JOIN levels m ON s.path = m.path AND s.pos > m.pos),
words AS MATERIALIZED (SELECT h.path, h.line, h.col, h.text, coalesce(k.block, 0) AS block, coalesce(k.last, 1000000000) AS last FROM held h ASOF LEFT JOIN blocks k ON h.path = k.path AND h.d = k.l AND h.pos > k.pos)"""
_line = lambda pos: f"length(substr(content, 1, {pos} - 1)) - length(replace(substr(content, 1, {pos} - 1), chr(10), ''))"
_col = lambda pos: f"length(regexp_extract(substr(content, 1, {pos} - 1), '[^\\n]*$'))"


@query(
    "g1_block_nodes",
    f"""WITH {BLOCKS} SELECT path, CAST(block AS INTEGER) AS block, CAST(last AS INTEGER) AS last, CAST(parent AS INTEGER) AS parent, CAST(l AS INTEGER) AS depth,
  CAST({_line('pos')} AS INTEGER) AS start_line, CAST({_col('pos')} AS INTEGER) AS start_col, CAST({_line('stop')} AS INTEGER) AS end_line, CAST({_col('stop')} + 1 AS INTEGER) AS end_col FROM blocks""",
)
def g1_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Nested blocks of any depth, here between the signs % and *."""
    return blocks.nested_blocks(files(spark, d), STYLES, {})


@query(
    "g12_contract_blocks",
    f"""WITH RECURSIVE {BLOCKS}, symbol AS (SELECT path, line, col, block FROM words WHERE regexp_full_match(text, '[A-Z][A-Za-z_]{{7,}}')),
kept AS MATERIALIZED (SELECT k.path, k.block, k.parent, s.block IS NOT NULL AS keep FROM blocks k LEFT JOIN (SELECT DISTINCT path, block FROM symbol) s ON k.path = s.path AND k.block = s.block),
climb AS (
  SELECT path, block, parent AS at FROM kept WHERE keep
  UNION ALL SELECT c.path, c.block, k.parent FROM climb c JOIN kept k ON c.path = k.path AND c.at = k.block WHERE NOT k.keep)
SELECT path || ':' || line || ':' || col || ':word' AS node_id, path || ':block:' || block AS anchor FROM symbol
UNION ALL SELECT c.path || ':block:' || c.block, c.path || ':block:' || c.at FROM climb c LEFT JOIN kept k ON c.path = k.path AND c.at = k.block WHERE c.at = 0 OR k.keep
UNION ALL SELECT path || ':block:0', NULL FROM files""",
)
def g12_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A tree as deep as the texts make it, contracted to its symbols, the blocks right around one, and the files."""
    return blocks.contracted_blocks(files(spark, d), config.SYMBOL, STYLES, {})


@query(
    "r4_innermost_scope",
    f"""WITH {BLOCKS}, defs AS (
  SELECT path, lower(text) AS symbol, block, any_value(last) AS last, min((line, col)) AS d FROM words WHERE regexp_matches(text, '^[A-Z]') GROUP BY 1, 2, 3)
SELECT w.path, w.line, w.col, w.path AS def_path, d[1] AS def_line, d[2] AS def_col
FROM words w JOIN defs x ON w.path = x.path AND w.text = x.symbol AND w.block BETWEEN x.block AND x.last WHERE regexp_matches(w.text, '^[a-z]')
QUALIFY row_number() OVER (PARTITION BY w.path, w.line, w.col ORDER BY x.block DESC) = 1""",
)
def r4_scope(spark: SparkSession, d: str) -> DataFrame:
    """Words in lower case resolved to the capitalised ones of the innermost block around them that has one."""
    return blocks.resolved_in_files(files(spark, d), "^[a-z]", "^[A-Z]", STYLES, {})


@query(
    "u3_custom_extractor",
    rf"""WITH {b.FILES}, lines AS (
  SELECT path, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS line, unnest(t) AS text FROM (SELECT path, string_split(content, chr(10)) AS t FROM files)),
pieces AS (SELECT path, line, generate_subscripts(p, 1) AS k, unnest(p) AS text FROM (SELECT path, line, regexp_extract_all(text, '[0-9]+|[^0-9]+') AS p FROM lines)),
found AS (
  SELECT path, line, CAST(coalesce(sum(length(text)) OVER (PARTITION BY path, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS col, text FROM pieces),
numbers AS (SELECT *, length(text) AS size FROM found WHERE regexp_full_match(text, '[0-9]+'))
SELECT n.path, n.line, n.col, n.text, CAST(n.size AS INTEGER) AS size, d.path AS def_path FROM numbers n
LEFT JOIN (SELECT text, min((path, line, col)) AS first FROM numbers GROUP BY text) f ON n.text = f.text AND (n.path, n.line, n.col) <> f.first
LEFT JOIN numbers d ON (d.path, d.line, d.col) = f.first""",
)
def u3_extractor(spark: SparkSession, d: str) -> DataFrame:
    """Numbers found by a function of the user's, each resolved to the first of its digits."""

    def numbers(path: str, language: str, content: str):
        import re

        for line, text in enumerate(content.split("\n")):
            for m in re.finditer("[0-9]+", text):
                yield line, m.start(), m.group(), len(m.group())

    found = written(hooks.extracted(files(spark, d), numbers, "size int"), "numbers")
    resolved = references.first_resolved(found, references.first_definitions(found)).select("path", "line", "col", "def_path")
    return found.join(resolved, ["path", "line", "col"], "left").select("path", "line", "col", "text", "size", "def_path")
