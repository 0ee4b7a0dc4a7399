"""Micro-fixtures with hand-derived results, and properties."""

import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from cartolith.functions import scalars
from cartolith.operators import context, crossfile, documents, graph, mental_model, precheck, references
from cartolith.plans import bindings
from cartolith.sources import files as sources
from cartolith.streaming import streams

from .conftest import DATA


def rows(df):
    return {tuple(r) for r in df.collect()}


def bfs(spark, edges, seeds):
    e = spark.createDataFrame(edges, "src string, dst string")
    s = spark.createDataFrame([(p, i + 1) for i, p in enumerate(seeds)], "path string, entry_ord int")
    return rows(context.multi_source_bfs(e, s))


def test_walk_over_a_cycle(spark):
    assert bfs(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], ["a"]) == {("a", 1, 0), ("b", 1, 1), ("c", 1, 2), ("d", 1, 2)}


def test_first_entry_point_wins(spark):
    found = bfs(spark, [("e1", "x"), ("x", "y"), ("e2", "y")], ["e1", "e2"])
    assert ("y", 1, 2) in found and ("e2", 2, 0) in found


def test_walk_against_one_entry_at_a_time(spark):
    rng = random.Random(3)
    n = 40
    edges = sorted({(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(70)})
    seeds = [str(x) for x in rng.sample(range(n), 4)]
    want = {}
    for i, s in enumerate(seeds):
        depth, queue = {s: 0}, deque([s])
        while queue:
            a = queue.popleft()
            for x, y in edges:
                if x == a and y not in depth:
                    depth[y] = depth[a] + 1
                    queue.append(y)
        for p, k in depth.items():
            want.setdefault(p, (i + 1, k))
    assert bfs(spark, edges, seeds) == {(p, *v) for p, v in want.items()}


def test_walk_through_files_without_a_brief(spark):
    walk = spark.createDataFrame([("e", 1, 0), ("n", 1, 1), ("c", 1, 2), ("z", 1, 3)], "path string, entry_ord int, depth int")
    briefs = spark.createDataFrame([("e", "E"), ("c", "C"), ("z", "")], "path string, brief string")
    included = context.first_inclusion(walk, briefs)
    assert {r.path for r in included.collect()} == {"e", "c"}
    assert context.concat_context(included).first().context == "E\n\nC"
    assert context.concat_context(included.limit(0)).first().context == ""
    assert [r.text for r in context.context_pieces(included).orderBy("place").collect()] == ["E", "\n\nC"]
    assert context.context_tokens(context.context_pieces(included)).first().context_tokens == 2
    assert context.context_tokens(context.context_pieces(included.limit(0))).first().context_tokens == 0


def test_trees_of_any_depth(spark):
    rng = random.Random(4)
    parent = {k: None if k < 3 else rng.randrange(max(0, k - 3), k) for k in range(200)}  # deep: each hangs from one of the three before
    keep = {k for k in parent if rng.random() < 0.1}
    want = {}
    for k in keep:
        up = parent[k]
        while up is not None and up not in keep:
            up = parent[up]
        want[str(k)] = None if up is None else str(up)
    tree = spark.createDataFrame([(str(k), None if p is None else str(p)) for k, p in parent.items()], "node_id string, parent_id string")
    assert dict(rows(graph.contract_tree(tree, spark.createDataFrame([(str(k),) for k in keep], "node_id string")))) == want


def test_leaves_against_a_plain_loop(spark):
    texts = ["a\r\nb c\rd", "\r", "é漢 foo_bar 1x\r\n\n zz", "x\r", "\ny", "AB", "", None, "one two\n" * 2000]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, content string")
    want = []
    for k, t in enumerate(texts):
        for line, text in enumerate(re.sub("\r\n?", "\n", t or "").split("\n")):
            found = list(re.finditer("[A-Za-z_]+", text))
            for i, m in enumerate(found):
                want.append((str(k), line, i, m.start(), m.end(), m.group(), found[i - 1].group() if i else None, found[i + 1].group() if i + 1 < len(found) else None))
    got = references.extract_leaves(df).select("path", "line", "ordinal", "col", "end_col", "text", "before", "after")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_only_changed_versions_pass(spark, tmp_path):
    schema = "namespace string, path string, sha1 string, updated_at long"
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    seen = []
    for batch in ([("n", "a", "1", 1), ("n", "b", "1", 1)], [("n", "a", "1", 2), ("n", "b", "2", 2), ("n", "b", "3", 3)], [("n", "b", "0", 1), ("n", "c", "1", 9)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        streams.run_available(streams.changed_file_stream(spark.readStream.schema(schema).parquet(source), str(tmp_path / "check"), out))
        seen.append(rows(spark.read.parquet(out).select("path", "sha1")))
    assert seen == [{("a", "1"), ("b", "1")}, {("a", "1"), ("b", "1"), ("b", "3")}, {("a", "1"), ("b", "1"), ("b", "3"), ("c", "1")}]


def test_critical_cycle_has_no_entry_point(spark):
    critical = spark.createDataFrame([("a",), ("b",)], "path string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert mental_model.entry_points(critical, edges).count() == 0
    assert mental_model.entry_points(critical, edges.where("src = 'a'")).collect()[0].path == "a"


def nodes_of(spark, items):
    return spark.createDataFrame(
        [(i, p, t, f, 0, c, 0, e, False, r, n) for i, p, t, f, c, e, r, n in items],
        "node_id string, parent_id string, node_type string, path string, start_line int, start_col int, end_line int, end_col int, is_definition boolean, is_reference boolean, name string",
    )


def test_shared_boundary_goes_to_the_first_leaf(spark):
    leaves = nodes_of(spark, [("n1", "p", "word", "f", 0, 3, True, "abc"), ("n2", "p", "word", "f", 3, 5, True, "de")])
    points = spark.createDataFrame([("x", "f", 0, 3), ("y", "f", 0, 4), ("z", "f", 0, 9)], "point_id string, path string, line int, col int")
    assert {(r.point_id, r.node_id) for r in graph.node_at_location(points, leaves).collect()} == {("x", "n1"), ("y", "n2")}


def test_range_join_keeps_its_equi_key(spark):
    leaves = nodes_of(spark, [("n1", "p", "word", "f", 0, 3, True, "abc")])
    points = spark.createDataFrame([("x", "f", 0, 3)], "point_id string, path string, line int, col int")
    plan = graph.node_at_location(points, leaves)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contraction_of_deep_chains(spark):
    depth = 37
    parents = [("root", None)] + [(f"n{k}", f"n{k - 1}" if k else "root") for k in range(depth)] + [("leaf", f"n{depth - 1}"), ("a", "b"), ("b", "a"), ("orphan", "gone")]
    tree = spark.createDataFrame(parents, "node_id string, parent_id string")
    keep = spark.createDataFrame([("root",), ("leaf",), ("n5",), ("a",), ("orphan",)], "node_id string")
    anchors = dict(rows(graph.contract_tree(tree, keep)))
    assert anchors.pop("a") in (None, "a")  # its chain goes round and meets no other kept node
    assert anchors == {"root": None, "n5": "root", "leaf": "n5", "orphan": None}


def test_promotion_names_the_parent(spark):
    nodes = nodes_of(spark, [("L", "P", "word", "f", 0, 3, True, "abc"), ("P", None, "line", "f", 0, 9, False, "NONE")])
    hits = spark.createDataFrame([("L", "P", "g", 1, 1)], "target string, target_parent string, path string, line int, col int")
    p = graph.promote_definition_parents(nodes, hits).where("node_id = 'P'").first()
    assert p.is_definition and p.name == "abc"


def test_self_reference_is_upstream_only(spark):
    nodes = nodes_of(spark, [("r", "l1", "word", "f", 0, 3, True, "abc"), ("t", "l2", "word", "f", 5, 8, True, "abc"), ("l1", None, "line", "f", 0, 9, False, "NONE"), ("l2", None, "line", "f", 0, 9, False, "NONE")])
    edges = spark.createDataFrame([("r", "t", "REFERENCES", 1)], "source string, target string, type string, sequence int")
    assert crossfile.downstream(nodes, edges).count() == 0
    assert rows(crossfile.upstream(nodes, edges)) == {("f", "f", "abc", "line")}
    assert crossfile.file_edges(crossfile.downstream(nodes, edges)).count() == 0


def test_edges_without_an_end_go_and_equal_ones_stay(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    edges = spark.createDataFrame([("a", "b", "REFERENCES", 1), ("a", "b", "REFERENCES", 1), ("a", "c", "REFERENCES", 1)], "source string, target string, type string, sequence int")
    assert sources.stored_edges(edges, nodes).count() == 2


def test_incremental_slice(spark):
    nodes = nodes_of(spark, [("a", None, "word", "changed", 0, 1, True, "a"), ("b", None, "word", "same", 0, 1, True, "b")])
    edges = spark.createDataFrame([("a", "b", "REFERENCES", 1), ("b", "b", "CONTAINS", 1)], "source string, target string, type string, sequence int")
    kept, touched = graph.slice_for_write(nodes, edges, spark.createDataFrame([("changed",)], "path string"))
    assert [r.node_id for r in kept.collect()] == ["a"] and touched.count() == 1


def test_shares_round_half_to_even(spark):
    langs = spark.createDataFrame([("a", 125, 1, True), ("b", 99875, 1, True)], "language string, tokens long, files long, supported boolean")
    assert {r.language: r.pct for r in precheck.language_distribution(langs).collect()} == {"a": 0.12, "b": 99.88}


def test_verdicts(spark):
    totals = spark.createDataFrame([("half", 100, 0.5, 9), ("none", 0, 0.0, 0), ("mixed", 100, 0.49, 9)], "repo string, total_tokens long, supported_ratio double, max_file_tokens long")
    assert {r.repo: r.code for r in precheck.precheck_verdict(totals).collect()} == {"half": None, "none": "NO_TOKENS_COUNTED", "mixed": "UNSUPPORTED_LANGUAGE_MIX"}


def test_job_fold_merges_field_by_field(spark):
    events = [("j", 1, 10, "r", "running", "A", "m1", "bad", None, 4, None), ("j", 2, 11, None, "running", "B", None, None, None, None, True), ("j", 3, 12, "r", "running", "B", None, None, None, None, None)]
    df = spark.createDataFrame(events, "job_id string, seq long, ts long, repo_name string, status string, stage string, metrics string, error string, batch_id string, batch_index int, abort boolean")
    job = documents.with_stages(documents.fold_jobs(df), documents.fold_stages(df)).first()
    assert (job.error, job.batch_index, job.created_at, job.updated_at, job.abort_requested, job.current_stage) == ("bad", 4, 10, 12, True, "B")
    assert set(job.stages) == {"A", "B"} and job.stages["A"].metrics == "m1"


def test_pages_are_clamped(spark):
    c = spark.createDataFrame([(i, "r", i) for i in range(5)], "conversation_id long, repo_id string, updated_at long")
    assert [r.conversation_id for r in documents.list_conversations(c, limit=0, offset=-3).collect()] == [4]
    assert documents.list_conversations(c, limit=999).count() == 5
    assert documents.clamped(999, 1, 500) == 500


def test_only_an_exact_ignore_is_ignored(spark):
    r = spark.createDataFrame([("r", "a", " IGNORE\n"), ("r", "b", "IGNORE.")], "repo_id string, path string, result string")
    assert {x.file_path: x.document_type for x in mental_model.classify_results(r).collect()} == {"a": "IGNORED_FILE", "b": "BRIEF_FILE_OVERVIEW"}


def test_scalars(spark):
    df = spark.createDataFrame([("src/A.PY", '[{"type":"text","text":"a"},{"text":"b"},"c"]'), (".gitignore", "plain"), ("x/tests/y.py", "[broken")], "path string, content string")
    got = df.select("path", scalars.language(F.col("path")).alias("l"), scalars.is_excluded(F.col("path")).alias("e"), scalars.normalise_content(F.col("content")).alias("c")).collect()
    assert [(r.l, r.e, r.c) for r in got] == [("python", False, "abc"), (None, False, "plain"), ("python", True, "[broken")]


def test_uri_paths_keep_plus(spark):
    df = spark.createDataFrame([("file:///repo/a%20b+c.py",), ("file:///other/x.py",), ("http:odd",)], "uri string")
    assert [r[0] for r in df.select(scalars.repo_relative(scalars.uri_path(F.col("uri")), "/repo")).collect()] == ["a b+c.py", None, None]


def test_leaves_have_code_point_columns(spark):
    df = spark.createDataFrame([("f", "é ab\r\n\n  x1y")], "path string, content string")
    got = {(r.line, r.col, r.end_col, r.text) for r in references.extract_leaves(df).collect()}
    assert got == {(0, 2, 4, "ab"), (2, 2, 3, "x"), (2, 4, 5, "y")}


def test_definitions_by_keyword(spark):
    df = spark.createDataFrame([("f.py", "def go(self):\n    return go")], "path string, content string")
    patterns = references.pattern_rows(spark, references.DEFAULT_HOOKS)
    leaves = references.extract_leaves(df.withColumn("language", scalars.language(F.col("path"))), ["language"])
    assert [(r.line, r.text, r.keyword) for r in references.extract_definitions(leaves, patterns).collect()] == [(0, "go", "def")]
    assert [(r.line, r.text) for r in references.extract_references(leaves, patterns).collect()] == [(1, "go")]


def test_span_over_lines(spark):
    df = spark.createDataFrame([("f", "abcdef\nghi\njklm")], "path string, content string")
    spans = spark.createDataFrame([("s", "f", 0, 2, 2, 2), ("t", "f", 1, 1, 1, 2)], "span_id string, path string, start_line int, start_col int, end_line int, end_col int")
    assert rows(references.span_text(df, spans)) == {("s", "cdef\nghi\njk"), ("t", "h")}


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a b.py").write_bytes(b"x = 1\n")
    (tmp_path / "bad.py").write_bytes(b"ok\xff")
    got = sources.scan_files(spark, str(tmp_path))
    assert {(r.path, r.content, r.size) for r in got.collect()} == {("d/a b.py", "x = 1\n", 6), ("bad.py", "ok", 2)}
    assert {(r.path, r.content) for r in sources.strict_text(got).collect()} == {("d/a b.py", "x = 1\n"), ("bad.py", "IGNORE")}
    assert sources.strict_text(got, None).count() == 1


def test_a_tree_of_thousands_of_files(spark, tmp_path):
    import time

    docs = spark.range(4000).select(F.concat(F.lit("src"), F.col("id") % 3).alias("folder"), F.when(F.col("id") > 0, F.concat(F.lit("ä\r\n"), F.col("id"))).alias("content")).unionByName(spark.createDataFrame([("src1", "twice\n")] * 2, "folder string, content string"))
    began = time.perf_counter()
    sources.write_tree(docs.repartition(4), f"file://{tmp_path}/tree")
    assert time.perf_counter() - began < 10  # Hadoop's text writer took about 13 ms of a core for each file
    got = sources.scan_files(spark, f"file://{tmp_path}/tree").select(F.regexp_extract("path", "folder=([^/]*)", 1), "content")
    assert sorted(map(tuple, got.collect())) == sorted((r.folder, (r.content or "") + "\n") for r in docs.collect())


def test_graph_tables_on_disk(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "r1"), ("b", "r2")], "node_id string, repo_id string")
    sources.write_nodes(nodes, str(tmp_path / "n"))
    sources.write_nodes(nodes.where("repo_id = 'r1'").withColumn("node_id", F.lit("c")), str(tmp_path / "n"))
    assert rows(spark.read.parquet(str(tmp_path / "n")).select("node_id", "repo_id")) == {("c", "r1"), ("b", "r2")}


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("k", 1, "a"), ("l", 5, "x")], "k string, v int, data string")
    new = spark.createDataFrame([("k", 2, "b"), ("l", 4, "y")], "k string, v int, data string")
    once = sources.upsert(old, new, ["k"], "v")
    assert rows(once) == {("k", 2, "b"), ("l", 5, "x")} == rows(sources.upsert(once, new, ["k"], "v"))


def test_written_tables_can_go(spark):
    from pathlib import Path

    from cartolith import storage

    df = storage.written(spark.range(3), "gone")
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert df.count() == 3 and folder.exists()
    storage.clear(spark)
    assert not folder.exists()


def test_nearest_definitions_agree_with_the_full_list(spark):
    rng = random.Random(8)
    spots = sorted({(rng.choice("abc"), f"d{rng.randrange(3)}/f{rng.randrange(4)}", rng.randrange(6), 0) for _ in range(90)})
    refs = spark.createDataFrame(spots, "symbol string, path string, line int, col int").dropDuplicates(["path", "line", "col"])
    defs = refs.where("line < 4")
    want = references.first_definition(references.resolve_references(refs, defs))
    assert rows(references.nearest_resolved(refs, defs)) == rows(want) == rows(references.first_resolved(refs, defs))
    assert rows(references.first_definition(references.resolve_references(refs, defs, most=1))) == rows(want)
    listed = lambda m: {(r.ref_path, r.ref_line, r.ref_column): [tuple(d)[:3] for d in r.mapping.definitions] for r in m.collect()}
    full, short = listed(references.resolve_references(refs, defs)), listed(references.resolve_references(refs, defs, most=3))
    assert full and short == {k: v[:3] for k, v in full.items()}


def test_places_within_groups_of_any_size(spark):
    values = [("hot", f"{k % 40:02d}") for k in range(200)] + [("one", "z"), (None, "a"), (None, "b")]
    df = spark.createDataFrame(values, "g string, v string")
    want = [("hot", f"{k // 5:02d}", k + 1) for k in range(200)] + [("one", "z", 1)]
    got = [(r.g, r.v, r.n) for r in context.numbered_within(df, "g", ("v",), "n").collect()]
    assert sorted(got) == sorted(want)  # rows of no group have no place
    assert context.numbered_within(df.limit(0), "g", ("v",), "n").count() == 0
    down = [(r.v, r.n) for r in context.numbered_within(df.where("g = 'one'").unionByName(spark.createDataFrame([("one", "y")], "g string, v string")), "g", (F.desc("v"),), "n").collect()]
    assert sorted(down) == [("y", 2), ("z", 1)]


def test_insights_as_lists_and_as_rows_agree(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "d")], "src string, dst string")
    texts = lambda *r: spark.createDataFrame(list(r), "path string, other string, text string")
    down, up = texts(("a", "b", "t1"), ("c", "b", "t2"), ("b", "d", "t3")), texts(("b", "a", "u1"), ("b", "c", "u2"), ("d", "b", "u3"))
    critical = spark.createDataFrame([("b",), ("d",), ("lone",)], "path string")
    flat = crossfile.interactions_flat
    lists = mental_model.enrich(critical, edges, flat(down), flat(up)).collect()
    assert {r.path for r in lists} == {"b", "d", "lone"}
    want = {(r.path, c, v) for r in lists for c in r.asDict() if c != "path" for v in r[c]}
    got = rows(mental_model.enrich_rows(critical, edges, down, up))
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_tree_by_lines_is_the_contracted_one(spark):
    """Against contraction and resequencing of the whole node table; no word is shuffled."""
    docs = spark.createDataFrame([("a/1.en", "one two\n\n12\nThree, four_x ü five\r\nsix\n"), ("a/2.en", ""), ("b.fr", "x\ny z\rw"), ("c.fr", "9 9\n")], "path string, content string")
    nodes = graph.build_node_table(docs, references.extract_leaves(docs))
    stay = spark.createDataFrame([("a/1.en:0:0:line:1",), ("a/1.en:3:0:line:1",), ("b.fr:1:0:line:1",)], "node_id string")
    got = graph.attached_by_lines(docs, stay)
    keep = nodes.where("node_type <> 'line'").select("node_id").union(stay)
    whole = graph.contract_tree(nodes, keep).where("anchor IS NOT NULL")
    assert rows(got.select("node_id", "anchor")) == rows(whole.select("node_id", "anchor")) and got.count() == whole.count() == 13
    last = nodes.withColumn("end_line", F.when(F.col("node_type") == "line", 99).otherwise(F.col("end_line")))
    ordered = graph.resequence(whole.select(F.col("anchor").alias("source"), F.col("node_id").alias("target")), last)
    assert rows(got.select("anchor", "node_id", "sequence")) == rows(ordered.select("source", "target", "sequence"))
    assert rows(got.select("node_id", "parent_id", "node_type")) == rows(nodes.where("node_type <> 'module'").join(keep, "node_id", "left_semi").select("node_id", "parent_id", "node_type"))


@pytest.mark.parametrize("name", ["g12_contract_tree", "g14_resequence", "g16_prune_graph", "g17_anchor_orphans"])
def test_contracted_words_are_not_shuffled(spark, name):
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0]


def test_leaves_by_kind_and_by_look_up(spark):
    docs = spark.createDataFrame([("a", "one two\n12"), ("b", "12")], "path string, content string")
    nodes = graph.build_node_table(docs, references.extract_leaves(docs))
    plain = nodes.withColumns({"is_reference": F.lit(False), "name": F.lit("NONE")})
    texts = nodes.where("node_type = 'word'").select("node_id", F.col("name").alias("text"))
    told = plain.join(texts, "node_id", "left")
    quick = graph.mark_leaf_references(told, inner="node_type <> 'word'")
    columns = ["node_id", "is_reference", "name"]
    assert rows(quick.select(columns)) == rows(graph.mark_leaf_references(plain, texts).select(columns)) and quick.where("is_reference").count() == 3
    assert "text" not in quick.columns


def test_rows_are_computed_once_to_be_numbered(spark):
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows_ = spark.range(0, 50, 1, 3).mapInArrow(each, "id long")
    assert {tuple(r) for r in context.numbered(rows_, ("id",), "n").select("id", "n").collect()} == {(i, i + 1) for i in range(50)}
    assert seen.value == 50


def test_tokens_are_counted_without_a_string_a_token(spark):
    texts = ["", "a", "ab_9 9é💡é\t..\r\n", "  ", None, "x1y2", "Zürich, 3.14\u00a0km", "é" * 40, "a b " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    counted = df.select("i", scalars.count_tokens(F.col("t")).alias("n"))
    assert "regexp" not in counted._jdf.queryExecution().toString()
    from cartolith.functions import config

    assert {r.i: r.n for r in counted.collect()} == {i: len(re.findall(config.TOKEN, t or "")) for i, t in enumerate(texts)}


def test_summaries_move_no_content(spark):
    files = spark.createDataFrame([("r", "a", "one two"), ("r", "b", " \n"), ("r", "c", None), ("r", "d", "x")], "repo_id string, path string, content string")
    edges = spark.createDataFrame([("a", "b"), ("c", "a")], "src string, dst string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = mental_model.default_summary(files, edges)
        assert rows(found.select("path", "result")) == {("a", "a: 2 tokens, uses 1, used by 1"), ("b", ""), ("c", ""), ("d", "IGNORE")}
        above = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
        assert "content" not in above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_words_are_found_in_little_memory():
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["p"] * 400), pa.array(["ab c\n" * 2000] * 400)], ["path", "content"])  # 4 MB
    tracemalloc.start()
    found = sum(b.num_rows for b in references._all_words(iter([batch]), ["path"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 400 * 4000
    assert peak < 30_000_000, peak


def test_one_definition_needs_no_second_look(spark):
    symbols = spark.createDataFrame([(s, p, line, 0) for p, text in {"a/1": "xyx", "a/2": "yz", "b/3": "xz"}.items() for line, s in enumerate(text)], "symbol string, path string, line int, col int")
    defs = references.first_definitions(symbols)
    found = references.only_resolved(symbols, defs)
    assert rows(found) == rows(references.first_resolved(symbols, defs)) and found.count() == 4
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # the definitions'


def test_model_documents_read_texts_once(spark):
    plan = bindings.model_documents(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "text#" not in plan
