"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.sources.spread import spread

from .alignment import align_documents
from .boosted_rules import judge
from .hmm import score_documents
from .jaccard_join import jaccard_components
from .line_crf import classify
from .mixing import mix
from .near_dedup import near_duplicates
from .prefix_trie import conversation_trie
from .sharding import shard_documents
from .token_counts import count_tokens
from .trie_bpe import encode_documents
from .url_rules import JUNK, filter_urls
from .vector_topk import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in ("documents", "pages") else scan


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("pattern")


def op2_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 40)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op8_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_rules, op2_minhash_join, op3_line_crf, op4_segment_topk, op5_lpt_shards, op6_token_counts, op7_hidden_markov, op8_trie_bpe, op9_source_mix, op10_boosted_rules, op11_jaccard_join, op12_conversation_trie, op13_pair_alignment)}


_junk = "|".join(JUNK)

OP1_SQL = rf"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(action, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.action, length(r.host || r.path)) AS action
  FROM split s JOIN rules r ON (s.host = r.host OR s.host LIKE '%.' || r.host) AND starts_with(s.path, r.path)
  GROUP BY page_id)
SELECT s.page_id, s.host, s.path, b.rule,
       coalesce(b.action, CASE WHEN regexp_matches(low, '(^|[^a-z0-9])({_junk})([^a-z0-9]|$)') AND NOT regexp_matches(low, '(^|[^a-z0-9])responsible([^a-z0-9]|$)gambling([^a-z0-9]|$)')
                               THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN best b USING (page_id)
"""


OP4_SQL = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


OP12_SQL = """
WITH turns AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS i, md5(coalesce(role, '') || chr(10) || coalesce(text, '')) AS g, octet_length(encode(coalesce(text, ''))) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS MATERIALIZED (
  SELECT c, n, c - c % 5 AS b, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c)),
rebuilt AS (
  SELECT i.c, t.i AS d, g, size FROM ids i JOIN turns t ON t.c = i.b AND t.i <= i.h
  UNION ALL SELECT i.c, t.i - i.h + least(i.h, coalesce(b.n, 0)), g, size FROM ids i JOIN turns t ON t.c = i.c AND t.i > i.h LEFT JOIN ids b ON b.c = i.b),
ways AS MATERIALIZED (
  SELECT c, d, size, md5(string_agg(g, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS key FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM ids),
nodes AS MATERIALIZED (SELECT d, key, min(c) AS r, count(*) AS n, any_value(size) AS size FROM ways GROUP BY d, key),
named AS MATERIALIZED (SELECT w.c, w.d, n.r FROM ways w JOIN nodes n ON w.d = n.d AND w.key = n.key),
hung AS MATERIALIZED (SELECT n.r, n.d, n.n, n.size, a.r AS pr FROM nodes n LEFT JOIN named a ON a.c = n.r AND a.d = n.d - 1),
children AS (SELECT pr AS r, d - 1 AS d, count(*) AS k FROM hung WHERE pr IS NOT NULL GROUP BY 1, 2),
full_ AS MATERIALIZED (SELECT h.*, coalesce(k, 0) AS k FROM hung h LEFT JOIN children c ON h.r = c.r AND h.d = c.d),
sums AS (
  SELECT a.r, a.d, count(*) FILTER (f.k = 0) AS leaves, CAST(sum((f.n - 1) * f.size) AS BIGINT) AS saved
  FROM full_ f JOIN named a ON a.c = f.r AND a.d <= f.d GROUP BY a.r, a.d),
ends AS (
  SELECT r, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
  FROM (SELECT c, d, r FROM named QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1) GROUP BY r, d)
SELECT f.r AS conv_id, CAST(f.d AS BIGINT) AS depth, f.pr AS parent_conv_id, f.n AS n_convs, CAST(f.k AS BIGINT) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_ f JOIN sums s ON f.r = s.r AND f.d = s.d LEFT JOIN ends e ON f.r = e.r AND f.d = e.d
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_rules": OP1_SQL, "op4_segment_topk": OP4_SQL, "op12_conversation_trie": OP12_SQL}
