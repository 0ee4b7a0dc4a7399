"""Queries of files, metrics, changes and references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config, scalars
from ..operators import changes, precheck, references
from ..sources import files as sources
from ..storage import new_folder
from . import bindings as b
from .registry import query

TOKENS = f"CAST(len(regexp_extract_all(content, '{config.TOKEN}')) AS BIGINT)"
STRUCT = "{'file_path': 'VARCHAR', 'line': 'INTEGER', 'column': 'INTEGER', 'location_string': 'VARCHAR'}"


@query("s1_scan_files", f"WITH {b.FILES} SELECT folder, length(content) AS chars, sha1(content) AS sha1 FROM files")
def s1(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a tree of files, one for each, and read back from there."""
    root = new_folder(spark, "s1_tree")
    sources.write_tree(b.files(spark, d), root)
    found = sources.scan_files(spark, root)
    text = F.expr("substring(content, 1, length(content) - 1)")  # a newline ends each file
    return found.select(F.regexp_extract("path", "folder=([^/]*)", 1).alias("folder"), (F.col("size") - 1).alias("chars"), F.sha1(text).alias("sha1"))


@query("s2_strict_text", f"WITH {b.FILES} SELECT path, length(content) AS chars FROM files")
def s2(spark: SparkSession, d: str) -> DataFrame:
    raw = b.files(spark, d).select("path", F.encode("content", "UTF-8").alias("raw"))
    return sources.strict_text(raw).select("path", F.length("content").cast("long").alias("chars"))


@query("s3_read_mappings", f"WITH {b.MAPPINGS} SELECT path AS ref_path, line AS ref_line, col AS ref_column, def_path || ':' || def_line || ':' || def_col AS first_definition FROM mappings")
def s3(spark: SparkSession, d: str) -> DataFrame:
    stored = b.mapping_cache(spark, d).withColumn("data", F.to_json("mapping")).drop("mapping")
    read = sources.read_mappings(stored)
    return read.select("ref_path", "ref_line", "ref_column", F.col("mapping.definitions")[0]["location_string"].alias("first_definition"))


@query("s4_write_nodes", f"WITH {b.FILES} SELECT CASE WHEN folder = 'src1' THEN 'new ' || path ELSE path END AS node_id, folder AS repo_id FROM files")
def s4(spark: SparkSession, d: str) -> DataFrame:
    """All nodes, then those of one repository again."""
    path = new_folder(spark, "s4_nodes")
    nodes = b.files(spark, d).select(F.col("path").alias("node_id"), F.col("folder").alias("repo_id"))
    sources.write_nodes(nodes, path)
    sources.write_nodes(nodes.where("repo_id = 'src1'").withColumn("node_id", F.concat(F.lit("new "), "node_id")), path)
    return spark.read.parquet(path).select("node_id", "repo_id")


@query("s5_stored_edges", f"WITH {b.MAPPINGS} SELECT path || ':' || line || ':' || col || ':word:2' AS source, def_path || ':' || def_line || ':' || def_col || ':word:2' AS target FROM mappings WHERE split_part(path, '/', 1) <> 'src3' AND split_part(def_path, '/', 1) <> 'src3'")
def s5(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = b.symbol_graph(spark, d)
    return sources.stored_edges(edges, nodes.where("path NOT LIKE 'src3/%'")).select("source", "target")


@query("s6_upsert_documents", f"WITH {b.FILES} SELECT path, CASE WHEN doc_id % 3 >= 1 THEN 'new' ELSE 'old' END AS state FROM files")
def s6(spark: SparkSession, d: str) -> DataFrame:
    f = b.files(spark, d)
    row = lambda state, version: f.select("repo_id", "path", F.lit(state).alias("state"), version.cast("int").alias("version"))
    return sources.upsert(row("old", F.lit(1)), row("new", F.col("doc_id") % 3), ["repo_id", "path"], "version").select("path", "state")


@query("s7_purge_repo", f"WITH {b.FILES} SELECT folder, count(*) AS files FROM files WHERE folder NOT IN ('src1', 'src2') GROUP BY folder")
def s7(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.createDataFrame([("src1",), ("src2",)], "folder string")
    return sources.purge(b.files(spark, d), gone, "folder").groupBy("folder").agg(F.count("*").alias("files"))


@query("s8_store_mapping", f"WITH {b.MAPPINGS} SELECT path AS ref_path, line AS ref_line, col AS ref_column, CASE WHEN line % 2 = 0 THEN 2 ELSE 1 END AS version FROM mappings")
def s8(spark: SparkSession, d: str) -> DataFrame:
    cache = b.mapping_cache(spark, d).select("namespace", "ref_path", "ref_line", "ref_column", F.lit(1).alias("version"))
    new = cache.where("ref_line % 2 = 0").withColumn("version", F.lit(2))
    broken = new.withColumn("ref_path", F.lit(None).cast("string"))
    return sources.store_mappings(cache, new.unionByName(broken)).select("ref_path", "ref_line", "ref_column", "version")


@query("f1_exclude_paths", f"WITH {b.FILES} SELECT path FROM files WHERE folder NOT IN ('src3', 'src7')")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return b.files(spark, d).where(~scalars.is_excluded(F.col("path"), b.IGNORE)).select("path")


@query("f2_select_code_files", f"WITH {b.FILES} SELECT path, lang AS language FROM files WHERE folder NOT IN ('src3', 'src7') AND lang IN ('en', 'fr')")
def f2(spark: SparkSession, d: str) -> DataFrame:
    found = b.files(spark, d).select("path", scalars.language(F.col("path"), b.LANGUAGES).alias("language"))
    return found.where(F.col("language").isNotNull() & ~scalars.has_ignored_part(F.col("path"), b.IGNORE))


@query("f3_select_analyzer_files", f"WITH {b.FILES} SELECT path FROM files WHERE folder NOT IN ('src3', 'src7') AND lang IN ('de', 'es') AND doc_id % 5 <> 0")
def f3(spark: SparkSession, d: str) -> DataFrame:
    f = b.files(spark, d).withColumn("shown", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(".hidden/"), "path")).otherwise(F.col("path")))
    shown = F.col("shown")
    return f.where(scalars.suffix(shown).isin(".de", ".es") & ~scalars.has_ignored_part(shown, b.IGNORE) & ~scalars.has_dot_part(shown)).select("path")


@query("f4_classify_language", f"WITH {b.FILES} SELECT path, CASE WHEN lang IN ('en', 'fr') THEN lang END AS language FROM files")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return b.files(spark, d).select("path", scalars.language(F.upper("path"), b.LANGUAGES).alias("language"))


@query("f5_language_label", f"WITH {b.FILES} SELECT path, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'unsupported/unknown' END AS language FROM files")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return b.files(spark, d).select("path", scalars.language_label(scalars.language(F.col("path"), b.LANGUAGES)).alias("language"))


@query("f6_detect_languages", f"WITH {b.FILES} SELECT DISTINCT lang AS language FROM files WHERE folder NOT IN ('src3', 'src7')")
def f6(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    langs = {f".{x}": x for x in ("de", "en", "es", "fr")}
    return b.files(spark, d).where(~scalars.has_ignored_part(path, b.IGNORE) & ~scalars.has_dot_part(path)).select(scalars.language(path, langs).alias("language")).where("language IS NOT NULL").distinct()


@query("f7_content_sha1", f"WITH {b.FILES} SELECT path, sha1(content) AS sha1 FROM files")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return b.files(spark, d).select("path", F.sha1("content").alias("sha1"))


@query("f8_count_tokens", f"WITH {b.FILES} SELECT path, {TOKENS} AS tokens, CAST(length(content) // 4 AS BIGINT) AS estimate FROM files")
def f8(spark: SparkSession, d: str) -> DataFrame:
    return b.files(spark, d).select("path", scalars.count_tokens(F.col("content")).alias("tokens"), scalars.estimate_tokens(F.col("content")).alias("estimate"))


@query("f9_repo_path", f"WITH {b.FILES} SELECT 'data/' || folder || '/' || path AS full_path FROM files")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return b.files(spark, d).select(F.concat_ws("/", F.lit("data"), "folder", "path").alias("full_path"))


@query("f10_location_string", f"WITH {b.SYMBOLS} SELECT path || ':' || line || ':' || col AS location FROM symbols")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return b.symbols(spark, d).select(scalars.location_string(F.col("path"), F.col("line"), F.col("col")).alias("location"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Raw replies of a definition query, made from mappings: half of one form, half of the other, some as lists."""
    m = b.mappings(spark, d)
    plain = '{"uri":"file:///repo/%s","range":{"start":{"line":%d,"character":%d},"end":{"line":%d,"character":%d}}}'
    target = plain.replace('"uri"', '"targetUri"').replace('"range"', '"targetRange"')
    args = ("def_path", "def_line", "def_col", "def_line", "def_col")
    return m.withColumn("final", F.when(F.col("line") % 2 == 0, F.format_string(plain, *args)).otherwise(F.concat(F.lit("["), F.format_string(target, *args), F.lit(',{"odd":1}]')))).withColumn(
        "partial", F.when(F.col("line") % 3 == 0, F.lit('[{"uri":"file:///repo/first%2Bone.py","range":{"start":{"line":1,"character":2}}}]'))
    )


@query(
    "f11_normalise_definitions",
    f"""WITH {b.MAPPINGS} SELECT path, line, col, 'file:///repo/' || def_path AS uri, def_line, def_col FROM mappings
UNION ALL SELECT path, line, col, 'file:///repo/first%2Bone.py', 1, 2 FROM mappings WHERE line % 3 = 0""",
)
def f11(spark: SparkSession, d: str) -> DataFrame:
    found = _replies(spark, d).select("path", "line", "col", F.explode(scalars.normalise_definitions(F.col("partial"), F.col("final"))).alias("x"))
    return found.select("path", "line", "col", "x.uri", F.col("x.line").alias("def_line"), F.col("x.column").alias("def_col"))


@query("f12_uri_to_repo_path", f"WITH {b.MAPPINGS} SELECT path AS ref_path, def_path AS path FROM mappings")
def f12(spark: SparkSession, d: str) -> DataFrame:
    found = _replies(spark, d).select(F.col("path").alias("ref_path"), F.explode(scalars.normalise_definitions(F.col("partial"), F.col("final"))["uri"]).alias("uri"))
    return references.to_repo_paths(found, "/repo", b.files(spark, d)).select("ref_path", "path")


@query("f13_drop_self_definitions", f"WITH {b.MAPPINGS} SELECT symbol, path, line, col FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.symbol = s.symbol AND d.def_path = s.path AND d.def_line = s.line AND d.def_col = s.col)")
def f13(spark: SparkSession, d: str) -> DataFrame:
    defs = b.definitions(spark, d).select("symbol", F.array(scalars.location(F.col("path"), F.col("line"), F.col("col"))).alias("definitions"))
    left = b.symbols(spark, d).join(defs, "symbol").withColumn("definitions", scalars.drop_self(F.col("definitions"), F.col("path"), F.col("line"), F.col("col")))
    return left.where(F.size("definitions") > 0).select("symbol", "path", "line", "col")


@query("f14_first_definition", f"WITH {b.MAPPINGS} SELECT path, line, col, def_path, def_line, def_col FROM mappings")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return references.first_definition(b.mapping_cache(spark, d))


@query(
    "f15_span_text",
    f"""WITH {b.SYMBOLS}, spans AS (
  SELECT path, min(line) AS a, max(line) AS z FROM symbols GROUP BY path),
text AS (SELECT l.path, string_agg(CASE WHEN l.line = s.a THEN substr(l.text, 2) ELSE l.text END, chr(10) ORDER BY l.line) AS t FROM lines l JOIN spans s ON l.path = s.path AND l.line BETWEEN s.a AND s.z GROUP BY l.path)
SELECT path AS span_id, trim(t, ' ') AS text FROM text""",
)
def f15(spark: SparkSession, d: str) -> DataFrame:
    spans = b.symbols(spark, d).groupBy("path").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"))
    whole = spans.select(F.col("path").alias("span_id"), "path", "start_line", F.lit(1).alias("start_col"), "end_line", F.lit(1 << 30).alias("end_col"))
    return references.span_text(b.files(spark, d), whole)


@query("f16_normalise_content", "SELECT conv_id, turn, 'a' || text AS content FROM conversations WHERE role <> 'system' UNION ALL SELECT conv_id, turn, text FROM conversations WHERE role = 'system'")
def f16(spark: SparkSession, d: str) -> DataFrame:
    segments = F.to_json(F.array(F.to_json(F.struct(F.lit("text").alias("type"), F.lit("a").alias("text"))), F.to_json(F.struct("text"))))
    rows = b.table(spark, d, "conversations").withColumn("raw", F.when(F.col("role") == "system", F.col("text")).otherwise(segments))
    return rows.select("conv_id", "turn", scalars.normalise_content(F.col("raw")).alias("content"))


@query("f17_whitelist_metrics", f"WITH {b.METRICS} SELECT path, 'total_tokens' AS metric, tokens AS value FROM metrics")
def f17(spark: SparkSession, d: str) -> DataFrame:
    m = b.metrics(spark, d).withColumn("m", F.create_map(F.lit("total_tokens"), "tokens", F.lit("secret"), "tokens"))
    return m.select("path", F.explode(scalars.whitelist(F.col("m"))).alias("metric", "value"))


@query("a1_file_metrics", f"WITH {b.METRICS} SELECT path, tokens, language, supported FROM metrics")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return b.metrics(spark, d)


@query("u2_tokenizer_hook", f"WITH {b.FILES} SELECT path, CAST(len(regexp_extract_all(content, '[A-Za-z]+')) AS BIGINT) AS tokens, length(content) // 4 AS estimate FROM files WHERE folder NOT IN ('src3', 'src7')")
def u2(spark: SparkSession, d: str) -> DataFrame:
    """Metrics with a user's tokenizer, and with the estimate."""

    @F.pandas_udf("long")
    def words(texts: pd.Series) -> pd.Series:
        return texts.str.count("[A-Za-z]+")

    found = precheck.file_metrics(b.files(spark, d), b.IGNORE, b.LANGUAGES, words("content")).select("path", "tokens")
    coarse = precheck.file_metrics(b.files(spark, d), b.IGNORE, b.LANGUAGES, scalars.estimate_tokens(F.col("content")))
    return found.join(coarse.select("path", F.col("tokens").alias("estimate")), "path")


@query("a2_scan_stats", f"WITH {b.FILES} SELECT count(*) AS total_files_seen, count(*) FILTER (folder NOT IN ('src3', 'src7')) AS total_files_tokenized, CAST(0 AS BIGINT) AS tokenization_errors, count(*) FILTER (folder IN ('src3', 'src7')) AS excluded_file_count FROM files")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return precheck.scan_stats(b.files(spark, d), b.IGNORE)


@query("a3_excluded_paths_top", f"WITH {b.FILES} SELECT folder, count(*) AS files FROM files WHERE folder IN ('src3', 'src7') GROUP BY folder ORDER BY files DESC, folder LIMIT 10")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return precheck.excluded_paths_top(b.files(spark, d), b.IGNORE)


@query("a4_by_language", f"WITH {b.METRICS} SELECT language, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS files, bool_or(supported) AS supported FROM metrics GROUP BY language")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return precheck.by_language(b.metrics(spark, d))


TOTALS = """CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(tokens) FILTER (supported), 0) AS BIGINT) AS supported_tokens, CAST(coalesce(sum(tokens) FILTER (NOT supported), 0) AS BIGINT) AS unsupported_tokens,
  count(*) FILTER (supported) AS supported_file_count, count(*) FILTER (NOT supported) AS unsupported_file_count,
  CASE WHEN sum(tokens) > 0 THEN CAST(coalesce(sum(tokens) FILTER (supported), 0) AS DOUBLE) / CAST(sum(tokens) AS DOUBLE) ELSE 0.0 END AS supported_ratio,
  CAST(coalesce(max(tokens), 0) AS BIGINT) AS max_file_tokens, CAST(coalesce(sum(tokens) // count(*), 0) AS BIGINT) AS avg_tokens_per_file"""


@query("a5_totals", f"WITH {b.METRICS} SELECT {TOTALS} FROM metrics")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return precheck.totals(b.metrics(spark, d))


@query("a6_supported_ratio", f"WITH {b.METRICS}, t AS (SELECT folder, {TOTALS} FROM metrics GROUP BY folder) SELECT folder, supported_ratio FROM t")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return precheck.totals(b.metrics(spark, d, ("folder",)), ["folder"]).select("folder", "supported_ratio")


@query("a7_largest_files", f"WITH {b.METRICS} SELECT path, tokens, language, supported FROM metrics ORDER BY tokens DESC, path LIMIT 10")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return precheck.largest_files(b.metrics(spark, d))


@query("a8_max_and_mean_tokens", f"WITH {b.METRICS}, t AS (SELECT folder, {TOTALS} FROM metrics GROUP BY folder) SELECT folder, max_file_tokens, avg_tokens_per_file FROM t")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return precheck.totals(b.metrics(spark, d, ("folder",)), ["folder"]).select("folder", "max_file_tokens", "avg_tokens_per_file")


LANGS = "langs AS (SELECT folder, language, supported, sum(tokens) AS tokens FROM metrics GROUP BY ALL)"


@query("a9_primary_language", f"WITH {b.METRICS}, {LANGS} SELECT folder, language AS primary_language FROM langs QUALIFY row_number() OVER (PARTITION BY folder ORDER BY supported DESC, tokens DESC, language) = 1")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return precheck.primary_language(precheck.by_language(b.metrics(spark, d, ("folder",)), ["folder"]), ["folder"])


PCT = "pcts AS (SELECT folder, language, CAST(round_even(CAST(tokens AS DOUBLE) / CAST(sum(tokens) OVER (PARTITION BY folder) AS DOUBLE) * 100, 2) AS DOUBLE) AS pct FROM langs WHERE supported)"


@query("a10_language_distribution", f"WITH {b.METRICS}, {LANGS}, {PCT} SELECT folder, language, pct FROM pcts")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return precheck.language_distribution(precheck.by_language(b.metrics(spark, d, ("folder",)), ["folder"]), ["folder"])


@query("a11_single_language_dominant", f"WITH {b.METRICS}, {LANGS}, {PCT} SELECT folder, max(pct) >= 70 AS single_language_dominant FROM pcts GROUP BY folder")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return precheck.single_language_dominant(precheck.language_distribution(precheck.by_language(b.metrics(spark, d, ("folder",)), ["folder"]), ["folder"]), ["folder"])


@query(
    "a12_precheck_summary",
    f"""WITH {b.METRICS}, t AS (SELECT {TOTALS} FROM metrics), l AS (SELECT language, supported, sum(tokens) AS tokens FROM metrics GROUP BY ALL)
SELECT total_tokens, supported_tokens, supported_ratio, max_file_tokens, (SELECT count(*) FROM files WHERE folder IN ('src3', 'src7')) AS excluded_file_count,
  (SELECT language FROM l WHERE supported ORDER BY tokens DESC, language LIMIT 1) AS primary_language, (SELECT path FROM metrics ORDER BY tokens DESC, path LIMIT 1) AS largest_file,
  (SELECT CAST(sum(tokens) AS BIGINT) FROM l WHERE language = 'en') AS en_tokens, total_tokens > 0 AND supported_ratio >= 0.5 AS passes_precheck
FROM t""",
)
def a12(spark: SparkSession, d: str) -> DataFrame:
    s = precheck.precheck_summary(b.files(spark, d), b.IGNORE, b.LANGUAGES)
    return s.select(
        "total_tokens", "supported_tokens", "supported_ratio", "max_file_tokens", "excluded_file_count", "primary_language", F.col("largest_files")[0]["path"].alias("largest_file"), F.col("tokens_by_lang")["en"].alias("en_tokens"), "passes_precheck"
    )


@query(
    "a13_precheck_verdict",
    f"""WITH {b.METRICS}, t AS (SELECT folder, {TOTALS} FROM metrics GROUP BY folder)
SELECT folder, CASE WHEN total_tokens <= 0 THEN 'NO_TOKENS_COUNTED' WHEN supported_ratio < 0.5 THEN 'UNSUPPORTED_LANGUAGE_MIX' END AS code, total_tokens > 0 AND supported_ratio >= 0.5 AS passes_precheck,
  CAST(CASE WHEN total_tokens <= 0 THEN 1 WHEN supported_ratio < 0.5 THEN 1 + CAST(max_file_tokens > 0 AS INTEGER) ELSE 0 END AS INTEGER) AS n_recommendations
FROM t""",
)
def a13(spark: SparkSession, d: str) -> DataFrame:
    totals = precheck.totals(b.metrics(spark, d, ("folder",)), ["folder"])
    return precheck.precheck_verdict(totals).select("folder", "code", "passes_precheck", F.size("recommendations").alias("n_recommendations"))


@query("c1_changed_files", f"WITH {b.STATE} SELECT namespace, path FROM changed")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return changes.changed_files(b.file_state(spark, d), b.previous_state(spark, d)).select("namespace", "path")


def _impacted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    cur, prev = b.file_state(spark, d), b.previous_state(spark, d)
    cache = b.mapping_cache(spark, d)
    index = changes.build_def_index(cache)
    changed = changes.changed_files(cur, prev)
    return cur, prev, cache, changed, changes.impacted_refs(index, changed)


@query("c2_impacted_refs", f"WITH {b.STATE} SELECT namespace, path FROM impacted")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return _impacted(spark, d)[4]


@query("c2_without_impacted", f"WITH {b.STATE} SELECT ref_path, ref_line, ref_column FROM cache k WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.namespace = k.namespace AND c.path = k.def_path)")
def c2b(spark: SparkSession, d: str) -> DataFrame:
    _, _, cache, changed, _ = _impacted(spark, d)
    return changes.without_impacted(cache, changes.build_def_index(cache), changed)[0].select("ref_path", "ref_line", "ref_column")


@query("c3_recompute_set", f"WITH {b.STATE} SELECT namespace, path FROM recompute")
def c3(spark: SparkSession, d: str) -> DataFrame:
    cur, _, _, changed, impacted = _impacted(spark, d)
    return changes.recompute_set(cur, changed, impacted)


@query("c4_carry_forward_mappings", f"WITH {b.STATE} SELECT ref_path, ref_line, ref_column FROM cache WHERE ref_path NOT IN (SELECT path FROM recompute) AND ref_path IN (SELECT path FROM prev)")
def c4(spark: SparkSession, d: str) -> DataFrame:
    cur, prev, cache, changed, impacted = _impacted(spark, d)
    return changes.carried_forward(cache, changes.recompute_set(cur, changed, impacted), cur, prev).select("ref_path", "ref_line", "ref_column")


@query("c5_build_def_index", f"WITH {b.STATE} SELECT DISTINCT namespace, def_path, ref_path, ref_line, ref_column FROM cache")
def c5(spark: SparkSession, d: str) -> DataFrame:
    return changes.build_def_index(b.mapping_cache(spark, d))


@query("c6_replace_mappings", f"WITH {b.STATE} SELECT ref_path, ref_line, ref_column, CASE WHEN ref_path IN (SELECT path FROM recompute) THEN 'new' ELSE 'old' END AS state FROM cache")
def c6(spark: SparkSession, d: str) -> DataFrame:
    cur, _, cache, changed, impacted = _impacted(spark, d)
    redo = changes.recompute_set(cur, changed, impacted)
    old = cache.select("namespace", "ref_path", "ref_line", "ref_column", F.lit("old").alias("state"))
    new = old.join(redo.withColumnRenamed("path", "ref_path"), ["namespace", "ref_path"], "left_semi").withColumn("state", F.lit("new"))
    return changes.replace_mappings(old, new, redo).select("ref_path", "ref_line", "ref_column", "state")


@query("c6_update_file_state", f"WITH {b.STATE} SELECT c.path, c.sha1 FROM cur c WHERE c.path IN (SELECT path FROM recompute) UNION ALL SELECT p.path, p.sha1 FROM prev p WHERE p.path NOT IN (SELECT path FROM recompute)")
def c6b(spark: SparkSession, d: str) -> DataFrame:
    cur, prev, _, changed, impacted = _impacted(spark, d)
    return changes.update_file_state(prev, cur, changes.recompute_set(cur, changed, impacted)).select("path", "sha1")


@query("c7_dedupe_positions", f"WITH {b.SYMBOLS} SELECT DISTINCT path, line, col FROM symbols")
def c7(spark: SparkSession, d: str) -> DataFrame:
    s = b.symbols(spark, d).select("path", "line", "col")
    return changes.dedupe_positions(s.union(s))


@query("c8_reset_namespace", f"WITH {b.STATE} SELECT namespace, path FROM prev WHERE namespace <> 'fr'")
def c8(spark: SparkSession, d: str) -> DataFrame:
    prev = b.previous_state(spark, d)
    resolver = lambda df, fr: df.select("namespace").distinct().withColumn("resolver", F.when(F.col("namespace") == "fr", fr).otherwise("r1"))
    return changes.reset_namespace(prev, resolver(prev, "r1"), resolver(prev, "r2")).select("namespace", "path")


@query("r1_extract_leaves", f"WITH {b.LEAVES} SELECT path, line, col, end_col, text FROM leaves")
def r1(spark: SparkSession, d: str) -> DataFrame:
    return b.leaves(spark, d).select("path", "line", "col", "end_col", "text")


@query("r2_extract_symbols", f"WITH {b.SYMBOLS} SELECT path, line, col, symbol FROM symbols")
def r2(spark: SparkSession, d: str) -> DataFrame:
    return b.symbols(spark, d).select("path", "line", "col", "symbol")


HOOKS = {"en": {"define": ("the", "of"), "stop": ("the", "of", "and", "a", "in")}, "fr": {"define": ("la", "le"), "stop": ("la", "le", "de", "et")}}
_near = "near AS (SELECT *, lag(text) OVER (PARTITION BY path, line ORDER BY ordinal) AS before, split_part(path, '.', 2) AS language FROM leaves)"


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """Leaves with their file's language."""
    return references.extract_leaves(b.files(spark, d).withColumn("language", scalars.language(F.col("path"), b.LANGUAGES)), ["language"])


@query("r2_extract_references", f"WITH {b.LEAVES}, {_near} SELECT path, line, col, text AS symbol FROM near WHERE (language = 'en' AND text NOT IN ('the', 'of', 'and', 'a', 'in') AND (before IS NULL OR before NOT IN ('the', 'of'))) OR (language = 'fr' AND text NOT IN ('la', 'le', 'de', 'et') AND (before IS NULL OR before NOT IN ('la', 'le')))")
def r2b(spark: SparkSession, d: str) -> DataFrame:
    return references.extract_references(_spoken(spark, d), references.pattern_rows(spark, HOOKS)).select("path", "line", "col", "symbol")


@query("r3_extract_definitions", f"WITH {b.LEAVES}, {_near} SELECT path, line, col, text AS symbol, before AS keyword FROM near WHERE (language = 'en' AND before IN ('the', 'of')) OR (language = 'fr' AND before IN ('la', 'le'))")
def r3(spark: SparkSession, d: str) -> DataFrame:
    return references.extract_definitions(_spoken(spark, d), references.pattern_rows(spark, HOOKS)).select("path", "line", "col", "symbol", "keyword")


@query("r3_first_definitions", f"WITH {b.MAPPINGS} SELECT symbol, def_path AS path, def_line AS line, def_col AS col FROM defs")
def r3b(spark: SparkSession, d: str) -> DataFrame:
    return b.definitions(spark, d)


@query(
    "r4_resolve_references",
    f"""WITH {b.SYMBOLS}, folder_defs AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY symbol, folder ORDER BY doc_id, line, col) = 1)
SELECT s.path, s.line, s.col, CAST(row_number() OVER (PARTITION BY s.path, s.line, s.col ORDER BY CASE WHEN s.path = d.path THEN 0 WHEN s.folder = d.folder THEN 1 ELSE 2 END, d.path, d.line, d.col) - 1 AS INTEGER) AS place,
  d.path || ':' || d.line || ':' || d.col AS definition
FROM symbols s JOIN folder_defs d ON s.symbol = d.symbol WHERE NOT (s.path = d.path AND s.line = d.line AND s.col = d.col)""",
)
def r4(spark: SparkSession, d: str) -> DataFrame:
    s = b.symbols(spark, d)
    defs = references.first_definitions(s, ("doc_id", "line", "col"), ["folder"])
    found = references.resolve_references(s, defs)
    return found.select(F.col("ref_path").alias("path"), F.col("ref_line").alias("line"), F.col("ref_column").alias("col"), F.posexplode("mapping.definitions").alias("place", "x")).select("path", "line", "col", "place", F.col("x.location_string").alias("definition"))


@query(
    "r4_nearest_resolved",
    f"""WITH {b.SYMBOLS}, folder_defs AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY symbol, folder ORDER BY doc_id, line, col) = 1)
SELECT s.path, s.line, s.col, d.path || ':' || d.line || ':' || d.col AS definition
FROM symbols s JOIN folder_defs d ON s.symbol = d.symbol WHERE NOT (s.path = d.path AND s.line = d.line AND s.col = d.col)
QUALIFY row_number() OVER (PARTITION BY s.path, s.line, s.col ORDER BY CASE WHEN s.path = d.path THEN 0 WHEN s.folder = d.folder THEN 1 ELSE 2 END, d.path, d.line, d.col) = 1""",
)
def r4b(spark: SparkSession, d: str) -> DataFrame:
    found = b.shared_symbols(spark, d)
    near = references.nearest_resolved(found, references.first_definitions(found, ("doc_id", "line", "col"), ["folder"]))
    return near.select("path", "line", "col", scalars.location_string(F.col("def_path"), F.col("def_line"), F.col("def_col")).alias("definition"))
