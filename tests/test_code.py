"""Lexical state, token patterns, nested blocks and scopes against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cartolith.operators import blocks, graph, lexing, references

from .test_core import rows


def plain_kinds(text, regions):
    data, kinds, i, r, level = text.encode(), [], 0, None, 0
    order = sorted(regions, key=lambda r: -len(r.open))
    here = lambda mark: mark and data.startswith(mark.encode(), i)
    while i < len(data):
        if r is None:
            r = next((x for x in order if here(x.open)), None)
            step, kind, level = (len(r.open), r.kind, 1) if r else (1, "code", 0)
        elif here(r.escape):
            step, kind = 2, r.kind
        elif here(r.close):
            step, kind, level = len(r.close), r.kind, level - 1
        elif r.nested and level < lexing.NESTED and here(r.open):
            step, kind, level = len(r.open), r.kind, level + 1
        elif data[i] == 10 and not r.multiline:
            step, kind, level = 1, "code", 0
        else:
            step, kind = 1, r.kind
        kinds += [kind] * min(step, len(data) - i)
        i, r = i + step, r if level else None
    return kinds


@pytest.mark.parametrize("language", list(lexing.REGIONS))
def test_kinds_against_a_plain_loop(language):
    rng = random.Random(2)
    parts = ['"', "'", "\\", "/", "*", "#", "\n", "a", "b c", '"""', "'''", "//", "/*", "*/", " ", "é", "xyz abc"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(600)] + [None, "", "/* " + "long " * 20000 + "*/ x"]
    lexer, t = lexing.Lexer(lexing.REGIONS[language]), lexing.Texts(pa.array(texts, pa.string()))
    got = [lexer.kinds[k] for k in lexer.kinds_at(t.data, t.offsets, np.arange(len(t.data)))]
    assert got == [k for x in texts for k in plain_kinds(x or "", lexing.REGIONS[language])]


def test_lexed_words(spark):
    df = spark.createDataFrame([("a.py", "python", 'x = "in s" # of c\r\ny'), ("b.txt", None, "no"), ("c.xx", "other", "no"), ("d.py", "python", None)], "path string, language string, content string")
    got = {(r.path, r.line, r.col, r.text, r.kind) for r in lexing.lexed_words(df).collect()}
    assert got == {("a.py", 0, 0, "x", "code"), ("a.py", 0, 5, "in", "string"), ("a.py", 0, 8, "s", "string"), ("a.py", 0, 13, "of", "comment"), ("a.py", 0, 16, "c", "comment"), ("a.py", 1, 0, "y", "code")}


SOURCES = {
    "java": ('class A extends p.B implements C, D { void run(int x) { new a.Foo(); bar(baz(1)); /* no(1) */ String s = "q(1)"; return go(2); } }', "extends:B implements:C implements:D new:Foo call:bar call:baz call:go", {"a", "p"}),
    "scala": ("class A extends B with C { def f(x: Int) = g(x) + new D(1) // h(1)\n}", "extends:B extends:C call:g new:D", set()),
    "rust": ('impl Shape for Circle { fn area(&self) { println!("x {}", f(1)); v.push(1); } } impl Foo { }', "impl:Shape macro:println call:f call:push impl:Foo", set()),
    "python": ('def f(a, b):\n    return g(a) + "h(1)"  # i\nclass K: pass', "name:g name:a name:pass", set()),
}


@pytest.mark.parametrize("language", list(SOURCES))
def test_references_by_patterns(spark, language):
    source, want, dotted = SOURCES[language]
    df = spark.createDataFrame([("f", language, source), ("empty", language, ""), ("null", language, None)], "path string, language string, content string")
    found = lexing.matched_references(df, lexing.pattern_table(spark)).orderBy("line", "col").collect()
    assert [f"{r.pattern}:{r.text}" for r in found if r.text not in dotted] == want.split()


def test_patterns_against_a_plain_matcher(spark):
    """Repetitions and look-ahead, on random tokens."""
    rng = random.Random(6)
    pattern = lexing.Pattern("x", "reference", "p", ("k", "%{", "%word", ",", "%}*"), (".", "%any", "%word"))
    text = "\n".join(" ".join(rng.choice(["k", "a", ",", ".", "stop", "b"]) for _ in range(rng.randrange(14))) for _ in range(800))
    want = []
    for line in text.split("\n"):
        tokens = line.split()
        is_word = lambda x: x in ("a", "b", "k")
        for i, x in enumerate(tokens):
            j = i
            while j >= 2 and tokens[j - 1] == "," and is_word(tokens[j - 2]):
                j -= 2
            starts = [s for s in range(j, i + 1, 1) if (i - s) % 2 == 0 and s >= 1 and tokens[s - 1] == "k"]
            if is_word(x) and starts and i + 3 < len(tokens) and tokens[i + 1] == "." and is_word(tokens[i + 3]):
                want.append(x)
    df = spark.createDataFrame([("f", "x", text)], "path string, language string, content string")
    got = lexing.matched_references(df, lexing.pattern_table(spark, [pattern], {"x": ["stop"]}), {}, within="line").orderBy("line", "col").collect()
    assert want and [r.text for r in got] == want


def stack_of(text):
    out, open_ = [], []
    for i, c in enumerate(text):
        if c == "{":
            out.append([i, len(text), open_[-1] + 1 if open_ else 0, len(open_) + 1])
            open_.append(len(out) - 1)
        elif c == "}" and open_:
            out[open_.pop()][1] = i + 1
    return out


def test_brackets_against_a_stack(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("{}{} aé") for _ in range(rng.randrange(50))) for _ in range(300)] + ["{a" * 3000 + "}" * 2999]
    df = spark.createDataFrame([(str(k), "java", t) for k, t in enumerate(texts)], "path string, language string, content string")
    got = sorted((int(r.path), r.block, r.parent, r.depth, r.start_col, r.end_col) for r in blocks.nested_blocks(df, regions={}).collect())
    assert got == [(k, n + 1, p, d, a, z) for k, t in enumerate(texts) for n, (a, z, p, d) in enumerate(stack_of(t))]
    want = []
    for k, t in enumerate(texts):
        spans = stack_of(t)
        for i, c in enumerate(t):
            if c == "a" and (i == 0 or t[i - 1] != "a") and k < 300:
                around = [n for n, (a, z, _, _) in enumerate(spans) if a <= i < z]
                want.append((k, i, around[-1] + 1 if around else 0))
    held = [(int(r.path), r.col, r.block) for r in blocks.scoped_words(df, regions={}).collect() if int(r.path) < 300]
    assert sorted(held) == sorted(want)


def test_indentation_against_spans_by_hand(spark):
    rng = random.Random(9)
    texts = ["\n".join(" " * rng.randrange(5) + rng.choice(["x", "y z", ""]) for _ in range(rng.randrange(12))) for _ in range(300)]
    want = []
    for k, t in enumerate(texts):
        lines = [(n, len(x) - len(x.lstrip()), len(x)) for n, x in enumerate(t.split("\n")) if x.strip()]
        spans = [(h, next((j for j in range(h + 1, len(lines)) if lines[j][1] <= lines[h][1]), len(lines))) for h in range(len(lines) - 1) if lines[h + 1][1] > lines[h][1]]
        for n, (h, j) in enumerate(spans):
            parent = max((m + 1 for m, (a, z) in enumerate(spans) if a < h < z), default=0)
            want.append((k, n + 1, parent, lines[h + 1][0], lines[h + 1][1], lines[j - 1][0], lines[j - 1][2]))
    df = spark.createDataFrame([(str(k), "python", t) for k, t in enumerate(texts)], "path string, language string, content string")
    got = [(int(r.path), r.block, r.parent, r.start_line, r.start_col, r.end_line, r.end_col) for r in blocks.nested_blocks(df).collect()]
    assert sorted(got) == want


def test_the_inner_definition_wins(spark):
    source = "{ X x { x X x { x } } { x } } x y"
    df = spark.createDataFrame([("f", "java", source), ("g", "java", "{ Y } y")], "path string, language string, content string")
    words = blocks.scoped_words(df)
    from pyspark.sql import functions as F

    named = words.withColumn("symbol", F.lower("text"))
    refs, defs = named.where("text IN ('x', 'y')"), named.where("text IN ('X', 'Y')")
    got = {(r.path, r.col): r.def_col for r in blocks.resolve_in_scope(refs, defs).collect()}
    assert got == {("f", 4): 2, ("f", 8): 10, ("f", 12): 10, ("f", 16): 10, ("f", 24): 2}  # none for the last x, y and g's y, which stand outside
    whole = {(r.path, r.col): (r.def_path, r.def_col) for r in blocks.scoped_or_nearest(refs, defs).collect()}
    assert whole[("f", 30)] == ("f", 2) and whole[("f", 32)] == ("g", 2) and whole[("g", 6)] == ("g", 2) and whole[("f", 16)] == ("f", 10)


def test_scopes_resolve_where_files_are_read(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    texts = ["".join(rng.choice(["{", "}", " x ", " X ", " y", "\n", " Xy ", "é ", " xY", " XY"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(str(k), "java", t) for k, t in enumerate(texts)] + [("none", None, "{X x}"), ("null", "java", None)], "path string, language string, content string")
    for refs, defs in (("^[a-z]", "^[A-Z]"), ("^x", "^X?x?Y?y?$")):  # of the latter a definition may be a reference
        got = blocks.resolved_in_files(df, refs, defs, regions={})
        named = blocks.scoped_words(df, regions={}).withColumn("symbol", F.lower("text"))
        want = rows(blocks.resolve_in_scope(named.where(F.col("text").rlike(refs)), named.where(F.col("text").rlike(defs))))
        assert rows(got) == want and len(want) > 100
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_only_matching_words_are_placed(spark):
    df = spark.createDataFrame([("f", "java", "{ X x { x é Xx } } // X\n x"), ("g", "java", "")], "path string, language string, content string")
    every = [tuple(r) for r in blocks.scoped_words(df).collect()]
    assert [tuple(r) for r in blocks.scoped_words(df, pattern="^X").collect()] == [r for r in every if r[4].startswith("X")] != []


def test_trees_contract_where_files_are_read(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["{", "{", "}", " x ", " S", "\n", "é ", " // S {\n"]) for _ in range(rng.randrange(60))) for _ in range(200)] + ["{" * 50 + " S " + "}" * 40]
    df = spark.createDataFrame([(str(k), "java", t) for k, t in enumerate(texts)] + [("none", None, "{S}"), ("null", "java", None)], "path string, language string, content string")
    words = blocks.scoped_words(df, pattern="^S$").where("kind = 'code'")
    tree = blocks.block_tree(df, blocks.nested_blocks(df), words)
    keep = tree.where("node_type <> 'block'").select("node_id").union(words.select(blocks.block_id("path", "block")))
    got = blocks.contracted_blocks(df, "^S$")
    want = rows(graph.contract_tree(tree, keep))
    assert rows(got) == want and got.count() == len(want) > 400
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_deep_tree_contracts(spark):
    df = spark.createDataFrame([("f", "java", "{" * 40 + " a " + "}" * 40 + " b")], "path string, language string, content string")
    tree = blocks.block_tree(df, blocks.nested_blocks(df), blocks.scoped_words(df))
    assert tree.count() == 43
    keep = tree.where("node_type <> 'block' OR node_id = 'f:block:7'").select("node_id")
    assert rows(graph.contract_tree(tree, keep)) == {("f:block:0", None), ("f:block:7", "f:block:0"), ("f:0:41:word", "f:block:7"), ("f:0:84:word", "f:block:0")}


def test_resolved_symbols_of_many_definitions(spark):
    """Ten thousand definitions of one symbol and as many references meet by distance, not pair by pair."""
    spots = spark.range(10_000).selectExpr("'get' AS symbol", "concat('d', id % 100, '/f', id % 1000) AS path", "CAST(id / 1000 AS INT) AS line", "CAST(id % 7 AS INT) AS col").dropDuplicates(["path", "line", "col"])
    found = references.nearest_resolved(spots, spots)
    assert found.count() == spots.count() and found.where("path <> def_path").count() == 0


def test_dyadic_cells_cover_a_span_once(spark):
    spans = [(a, b) for a in range(0, 40, 3) for b in range(a, 45, 4)] + [(7, 1_000_006), (0, 1 << 20), (5, 5)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(spans, "a int, b int").withColumn("c", graph.dyadic(F.col("a"), F.col("b")))
    for r in df.collect():
        covered = sorted((c.cell << c.level, (c.cell + 1) << c.level) for c in r.c)
        assert covered[0][0] == r.a and covered[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
        assert len(covered) < 50


def test_leaves_of_a_million_lines(spark):
    schema = "path string, node_id string, parent_id string, name string, start_line int, start_col int, end_line int, end_col int"
    leaves = spark.createDataFrame([("f", "long", None, "L", 3, 5, 1_000_003, 2), ("f", "in", "long", "I", 500, 0, 520, 9), ("g", "one", None, "O", 0, 0, 0, 3)], schema)
    points = spark.createDataFrame([("a", "f", 3, 4), ("b", "f", 3, 5), ("c", "f", 510, 0), ("d", "f", 1_000_003, 2), ("e", "f", 1_000_003, 3), ("h", "g", 0, 3), ("i", "g", 1, 0)], "point_id string, path string, line int, col int")
    got = {(r.point_id, r.node_id, r.line) for r in graph.node_at_location(points, leaves).collect()}
    assert got == {("b", "long", 3), ("c", "long", 510), ("d", "long", 1_000_003), ("h", "one", 0)}
    plan = graph.node_at_location(points, leaves)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_spans_of_many_lines_are_one_row(spark):
    text = "\r\n".join(f"line {k}" for k in range(20_000))
    df = spark.createDataFrame([("f", text), ("g", "ab\n\ncd")], "path string, content string")
    spans = [("all", "f", 0, 0, 19_999, 99), ("two", "f", 1, 5, 3, 2), ("past", "f", 0, 90, 1, 4), ("none", "g", 7, 0, 8, 1), ("over", "g", 1, 0, 9, 9), ("back", "g", 2, 2, 2, 0)]
    got = {(r.span_id): r.text for r in references.span_text(df, spark.createDataFrame(spans, "span_id string, path string, start_line int, start_col int, end_line int, end_col int")).collect()}
    assert got == {"all": text.replace("\r\n", "\n"), "two": "1\nline 2\nli", "past": "\nline".strip(" "), "over": "\ncd", "back": ""}


def test_an_extractor_of_ones_own(spark):
    from cartolith.operators import hooks

    df = spark.createDataFrame([("f", "x", "ab AB\ncd"), ("g", None, None)], "path string, language string, content string")
    words = lambda path, language, content: [(k, 0, t.split()[0], len(t)) for k, t in enumerate(content.split("\n")) if t]
    got = hooks.extracted(df, words, "size int")
    assert rows(got) == {("f", "x", 0, 0, 2, "ab", "ab", 5), ("f", "x", 1, 0, 2, "cd", "cd", 2)}
    assert references.first_definitions(got).count() == 2
    with pytest.raises(Exception, match="further values"):
        hooks.extracted(df, words).collect()


def test_slices_are_small():
    """What a worker holds for one pass is bounded by the slice: about a hundred bytes for each of its bytes."""
    texts = ["x" * (1000 + k % 700) for k in range(3000)]
    batch = pa.RecordBatch.from_pydict({"language": ["en"] * len(texts), "content": texts})
    sizes = [sum(map(len, rows.column("content").to_pylist())) for _, rows in lexing.sliced([batch])]
    assert sum(sizes) == sum(map(len, texts)) and max(sizes) <= (1 << 18) + 2 * max(map(len, texts))
