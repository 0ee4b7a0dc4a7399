"""Tables kept up to date by changes against full runs, on random edits."""

import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartolith.operators import context, incremental, references
from cartolith.sources.store import KeyedStore, added, newest
from cartolith.storage import written

from .test_core import rows


def test_one_key_of_a_million_rewrites_one_bucket(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), StructType.fromDDL("k long, v long, data string"), ["k"], 32)
    many = spark.range(1_000_000).selectExpr("id AS k", "1L AS v", "'old' AS data")
    assert len(store.update(many, newest(["k"], "v"))) == 32
    before = store.manifest()
    touched = store.update(spark.createDataFrame([(77, 2, "new"), (77, 1, "late")], "k long, v long, data string"), newest(["k"], "v"))
    after = store.manifest()
    assert len(touched) == 1 and [b for b in before if before[b] != after[b]] == touched
    assert store.read().count() == 1_000_000 and rows(store.read().where("data <> 'old'")) == {(77, 2, "new")}
    assert rows(store.read(version=1).where("k = 77")) == {(77, 1, "old")}  # a reader of the version before
    assert store.update(many.limit(0), newest(["k"], "v")) == [] and store.version() == 2


def test_an_update_that_fails_leaves_the_version_before(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), StructType.fromDDL("k long, n long"), ["k"], 4)
    df = spark.createDataFrame([(1, 5), (2, 1)], "k long, n long")
    store.update(df, added(["k"], ["n"]))
    try:
        store.update(df, lambda old, new: old.unionByName(new).withColumn("n", F.expr("raise_error('lost')").cast("long")))
    except Exception:
        pass
    assert store.version() == 1 and rows(store.read()) == {(1, 5), (2, 1)}
    store.update(spark.createDataFrame([(1, -5), (3, None)], "k long, n long"), added(["k"], ["n"]))
    assert rows(store.read()) == {(2, 1)}  # a count of 0 goes, and so does a bucket without rows


def test_maintained_tables_equal_a_full_run(spark, tmp_path):
    rng = random.Random(11)
    resolve = lambda s: references.nearest_resolved(s, references.first_definitions(s, ("path", "line", "col")))
    text = lambda: [(rng.choice("abcdefgh"), line) for line in range(rng.randrange(4))]
    files = {f"f{k:02d}": text() for k in range(20)}
    table = lambda f: spark.createDataFrame([(s, p, line, 0) for p, t in f.items() for s, line in t], "symbol string, path string, line int, col int")
    edges = KeyedStore(spark, str(tmp_path / "e"), StructType.fromDDL(incremental.EDGES), ["src", "dst"], 4)
    degrees = KeyedStore(spark, str(tmp_path / "d"), StructType.fromDDL(incremental.DEGREES), ["path"], 4)
    entries, linked = set(), set()
    before = {}
    for step in range(4):
        changed = spark.createDataFrame([(p,) for p in {*before, *files} if before.get(p) != files.get(p)], "path string")
        gone, come = incremental.mapping_changes(table(before), table(files), changed, resolve)
        moved, points = incremental.maintain(edges, degrees, gone, come)
        moved, points = rows(moved), rows(points)
        full = resolve(table(files)).where("path <> def_path").groupBy(F.col("path").alias("src"), F.col("def_path").alias("dst")).agg(F.count("*").alias("support"))
        want = rows(full)
        assert rows(edges.read()) == want
        links = {(a, z) for a, z, _ in want}
        assert {(a, z) for a, z, c in moved if c == 1} == links - linked and {(a, z) for a, z, c in moved if c == -1} == linked - links
        ends = {a for a, _ in links} - {z for _, z in links}
        assert {p for p, c in points if c == 1} == ends - entries and {p for p, c in points if c == -1} == entries - ends
        assert rows(incremental.entry_points(degrees.read())) == {(p,) for p in ends}
        entries, linked, before = ends, links, dict(files)
        for p in rng.sample(sorted(files), 3):
            files[p] = text()
        files.pop(rng.choice(sorted(files)))
        files[f"n{step}"] = text()


def test_interactions_and_nodes_equal_a_full_run(spark, tmp_path):
    rng = random.Random(17)
    text = lambda: [(rng.choice("abcde"), line) for line in range(rng.randrange(5))]
    files = {f"f{k:02d}": text() for k in range(15)}
    table = lambda f: spark.createDataFrame([(s, p, line, 0, s.upper()) for p, t in f.items() for s, line in t], "symbol string, path string, line int, col int, name string")

    def resolve(s):
        found = references.nearest_resolved(s, references.first_definitions(s, ("path", "line", "col")))
        return found.join(s.select("path", "line", "col", "name"), ["path", "line", "col"]).withColumn("node_type", F.lit("line"))

    store = lambda name, ddl, keys: KeyedStore(spark, str(tmp_path / name), StructType.fromDDL(ddl), keys, 4)
    down = store("down", incremental.DOWNSTREAM, ["path", "ref_name", "node_type", "def_path"])
    up = store("up", incremental.UPSTREAM, ["path", "ref_path", "ref_name", "node_type"])
    nodes = store("nodes", "path string, line int, name string", ["path"])
    before, there = {}, set()
    for step in range(3):
        changed = spark.createDataFrame([(p,) for p in {*before, *files} if before.get(p) != files.get(p)], "path string")
        gone, come = (written(t, "mappings") for t in incremental.mapping_changes(table(before), table(files), changed, resolve))
        moved = rows(incremental.maintain_support(down, incremental.downstream_rows(gone), incremental.downstream_rows(come)))
        incremental.maintain_support(up, incremental.upstream_rows(gone), incremental.upstream_rows(come))
        incremental.maintain_files(nodes, table(files).select("path", "line", "name"), changed)
        full = resolve(table(files))
        for kept, counted in ((down, incremental.downstream_rows(full)), (up, incremental.upstream_rows(full))):
            assert rows(kept.read()) == rows(counted.groupBy(*kept.keys).agg(F.count("*")))
        now = {r[:-1] for r in rows(down.read())}
        assert {r[:-1] for r in moved if r[-1] == 1} == now - there and {r[:-1] for r in moved if r[-1] == -1} == there - now
        assert rows(nodes.read()) == {(p, line, s.upper()) for p, t in files.items() for s, line in t}
        there, before = now, dict(files)
        for p in rng.sample(sorted(files), 3):
            files[p] = text()
        files.pop(rng.choice(sorted(files)))
        files[f"n{step}"] = text()


def test_an_unchanged_file_leaves_its_bucket(spark, tmp_path):
    nodes = KeyedStore(spark, str(tmp_path / "n"), StructType.fromDDL("path string, v int"), ["path"], 16)
    rows_ = spark.createDataFrame([(f"f{k}", k) for k in range(100)], "path string, v int")
    incremental.maintain_files(nodes, rows_, rows_)
    held = nodes.manifest()
    assert len(incremental.maintain_files(nodes, rows_, rows_.where("v = 7"))) == 1
    assert sum(held[k] != folder for k, folder in nodes.manifest().items()) == 1
    assert incremental.maintain_files(nodes, rows_, rows_.limit(0)) == []


def test_a_repaired_walk_equals_a_full_one(spark):
    rng = random.Random(13)
    table = lambda e: spark.createDataFrame(sorted(e), "src string, dst string")
    entry = lambda s: spark.createDataFrame([(x, x) for x in sorted(s)], "path string, entry_ord string")
    for n, links in ((12, 16), (40, 70), (25, 60)):
        name = lambda: f"{rng.randrange(n):02d}"  # noqa: B023, E731
        old = {(name(), name()) for _ in range(links)} | {("00", "01"), ("01", "02"), ("02", "00")}
        seeds = {name() for _ in range(3)} | {"00"}
        walk = context.multi_source_bfs(table(old), entry(seeds))
        new = set(rng.sample(sorted(old), len(old) * 3 // 4)) | {(name(), name()) for _ in range(5)}
        after = (seeds - {"00"}) | {name()}
        assert rows(context.repaired_walk(walk, table(old), table(new), entry(after))) == rows(context.multi_source_bfs(table(new), entry(after)))


def test_a_cycle_does_not_hold_itself_up(spark):
    table = lambda e: spark.createDataFrame(e, "src string, dst string")
    entry = spark.createDataFrame([("s", "s")], "path string, entry_ord string")
    old = table([("s", "a"), ("a", "b"), ("b", "c"), ("c", "a")])
    new = table([("a", "b"), ("b", "c"), ("c", "a")])
    assert rows(context.repaired_walk(context.multi_source_bfs(old, entry), old, new, entry)) == {("s", "s", 0)}


def test_a_walk_broadcasts_no_table_of_many_files(spark, monkeypatch):
    plans = []

    def spied(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(context, "written", spied)
    many = spark.range(25_000).select(*(F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in "abc"))
    pairs = lambda a, z: many.select(F.col(a).alias("src"), F.col(z).alias("dst"))
    entry = lambda c: many.select(F.col(c).alias("path"), F.col(c).alias("entry_ord"))
    old, new = pairs("a", "b").union(pairs("b", "c")), pairs("b", "c")
    walk = context.repaired_walk(context.multi_source_bfs(old, entry("a")), old, new, entry("b"))
    want = entry("b").withColumn("depth", F.lit(0)).union(many.select("c", "b", F.lit(1)))
    assert walk.count() == 50_000 and walk.exceptAll(want).isEmpty()
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)
