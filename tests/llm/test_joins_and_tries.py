"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, long texts and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartolith.llm import alignment, boosted_rules, hmm, jaccard_join, prefix_trie, skew
from cartolith.llm.queries import tokenizer_path

from ..conftest import DATA
from .test_operators import components_of

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


# 11


def near_texts(rng, n=500):
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))] for _ in range(25)]
    template = [f"t{i}" for i in range(100)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
        out.append(" ".join(w + list(rng.choice(base))[: rng.randrange(20)] * (rng.random() < 0.3)))
    out += [" ".join([*template, *(f"o{rng.randrange(10**6)}" for _ in range(40))]) for _ in range(120)]  # one template, different rest
    out += [" ".join(template[:k] + [f"z{k}"] + template[k + 1 :]) for k in range(100)]
    return out + ["", None, "a", "A", "a b c d", "A b C d", " \n ", "long " * 300_000, "long " * 300_001, "x" * (2 << 20)]


@pytest.mark.parametrize(("block", "mass"), [(512, 1 << 20), (16, 400)])
def test_jaccard_components(spark, monkeypatch, block, mass):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "MASS", mass)
    texts = near_texts(random.Random(5))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == components_of(dict(enumerate(texts)), 5)


def test_jaccard_of_odd_rows(spark, odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()]
    assert len(got) == odd.count() and got.count(next(x for x in got if x[0] == 1)) == 2
    assert {(i, n, c) for i, n, c in got if i is None} == {(None, 16, None)}
    assert {i: c for i, _, c in got if i in (1, 2, 11, 3, 4, 6, 7)} == {1: 1, 2: 1, 11: 1, 3: 3, 4: 4, 6: 6, 7: 6}
    assert jaccard_join.jaccard_components(none).count() == 0


def test_bounds_that_skip_are_bounds():
    """No pair that is linked is passed over by place, parity or answers."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, jaccard_join.CELLS).astype(np.uint32)
    whole = np.unique(rng.integers(1, 1 << 63, 400).astype(np.uint64))
    sets = [np.sort(rng.choice(whole, rng.integers(40, 80), replace=False)) for _ in range(30)]
    sets += [np.sort(np.concatenate([s[: -int(k)], rng.choice(np.setdiff1d(whole, s), int(k), replace=False)])) for s in sets for k in (1, 3, 6)]
    sets = [np.unique(s) for s in sets]
    parities = jaccard_join.Parities(pa.array([jaccard_join.parity(s) for s in sets]))
    near = 0
    for x in range(len(sets)):
        first = jaccard_join.prefix(sets[x], counts, 80)
        for y in range(len(sets)):
            shared = len(np.intersect1d(sets[x], sets[y]))
            differ = len(sets[x]) + len(sets[y]) - 2 * shared
            assert parities.differ(np.array([x]), np.array([y]))[0] <= differ
            if 100 * shared >= 80 * (len(sets[x]) + len(sets[y]) - shared):
                near += x != y
                other = jaccard_join.prefix(sets[y], counts, 80)
                common = [k for k in first if k in other]
                assert common and min(len(sets[x]) - list(first).index(common[0]), len(sets[y]) - list(other).index(common[0])) >= shared
    left, right = [(k, s) for k, s in enumerate(sets[:60])], [(1000 + k // 4, s) for k, s in enumerate(sets[60:])]
    want = {(a, b) for a, s in left for b, t in right if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))}
    assert near and jaccard_join.answers(left, right, 80) == want


# 12


def trie_of(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    full = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        leaf = lambda m: not any(len(o) == len(m) + 1 and o[: len(m)] == m for o in members)
        ends = sorted(c for c in convs if len(full[c]) == len(node))
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        children = sum(len(m) == len(node) + 1 for m in below)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children, sum(map(leaf, below)), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def trie_rows(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("largest", [1 << 13, 20])
def test_trie(spark, largest):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "", "é漢", None])) for c in range(1, 90) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]  # a hot conversation
    rows += [(500, t, "user", f"deep {t}") for t in range(120)] + [(503, t, "user", f"deep {t}") for t in range(60)]
    rows += [(600, None, None, None), (600, 2, "b", "x"), (601, 0, "a", "only"), (None, 0, "a", "lost"), (700, 1, "a", "t"), (700, 1, "b", "t"), (700, 1, "b", "t")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("size", F.lit("clash")).repartition(6)
    assert trie_rows(prefix_trie.conversation_trie(df, largest=largest)) == trie_of(rows)


def test_trie_of_nothing_and_of_one_long_conversation(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    long = spark.range(6000).selectExpr("CAST(5 AS LONG) AS conv_id", "id AS turn", "'r' AS role", "'x' AS text").repartition(7)
    got = prefix_trie.conversation_trie(long, largest=500).agg(F.count("*"), F.max("depth"), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    assert tuple(got) == (6001, 6000, 6001, 0)
    big = spark.createDataFrame([(1, 0, "r", "y" * (3 << 20)), (2, 0, "r", "y" * (3 << 20)), (3, 0, "r", None)], schema)
    assert trie_rows(prefix_trie.conversation_trie(big)) == trie_of([tuple(r) for r in big.collect()])


def test_sums_over_random_forests():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 3000):
        parent = np.array([-1 if k == 0 or rng.random() < 0.02 else int(rng.integers(max(0, k - 4), k)) for k in range(n)])
        own, values = rng.integers(1, 5, n), rng.integers(0, 9, (n, 2))
        weight, want = own.copy(), values.copy()
        for k in range(n - 1, -1, -1):
            if parent[k] >= 0:
                weight[parent[k]] += weight[k]
                want[parent[k]] += want[k]
        assert (prefix_trie.split_inside(parent, weight, values) == want).all()


def test_running_sums_across_ranges(spark):
    values = [(g, i, (i * 7919 + g) * (1 << 50)) for g, n in ((1, 500), (2, 3), (3, 900), (4, 1)) for i in range(n)]
    wrapped = [(g, i, (v + (1 << 63)) % (1 << 64) - (1 << 63)) for g, i, v in values]
    df = spark.createDataFrame(wrapped, "g long, i long, v long").repartition(9)
    total, want = defaultdict(int), set()
    for g, i, v in wrapped:
        total[g] += v
        want.add((g, i, (total[g] + (1 << 63)) % (1 << 64) - (1 << 63), i + 1))
    assert {tuple(r) for r in prefix_trie.running(df, "g", ["g", "i"], ["v"], "n").select("g", "i", "v", "n").collect()} == want


def test_hot_keys_of_several_small_numbers(spark):
    rows = spark.range(6000).selectExpr("CAST(id % 3 AS LONG) AS a", "CAST(1 AS INT) AS b")
    table = spark.createDataFrame([(0, 1, "x"), (1, 1, "y")], "a long, b int, v string")
    assert Counter(r.v for r in skew.look_up(rows, table, ["a", "b"], "left").collect()) == {"x": 2000, "y": 2000, None: 2000}


# 13


def plain_alignment(texts):
    """Both encoders over whole texts, and each row of the result by walking both token lists."""
    import sentencepiece

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    own = alignment.Aligner(A, B)
    rows, counts = [], Counter()
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        parts = [own.bytes_a[i] for i in a], [own.bytes_b[i] for i in b]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            rows.append(([], 0, 0, 0, ""))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        i = j = 0
        links, groups, held = [], [], ([], [])
        seen = (-1, -1)
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            if i != seen[0]:
                held[0].append(a[i])
            if j != seen[1]:
                held[1].append(b[j])
            seen = (i, j)
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append("|".join(",".join(map(str, h)) for h in held))
                held = ([], [])
        counts.update(links)
        rows.append((links, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(a, b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), h) for links, a, b, g, h in rows]


def odd_texts():
    rng = random.Random(1)
    parts = ["a", "b", "the", "The", "  ", " ", " ", " ", "\n", "\t", "é", "漢", "字", "'s", "1", "23", "<s>", "</s>", "<|endoftext|>", "<0x41>", "▁", " ", "　", "!", "...", "ing", "\x00", "x", " \n ", "\r\n", "🙂"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)] + [None, "", " ", "  ", "a ", "same", "same", "word " * 250_000, "x" * 50_000]


@pytest.mark.parametrize("head", [1 << 22, 60])
def test_alignment(spark, head):
    texts = odd_texts()
    df = spark.createDataFrame([(None if k % 50 == 7 else k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, row int").repartition(4)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [tuple(r[c] for c in ["doc_id", *names]) for r in alignment.align_documents(df, A, B, head).collect()]
    want = [(None if k % 50 == 7 else k, *r) for k, r in enumerate(plain_alignment(texts))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert alignment.align_documents(df.limit(0), A, B, head).count() == 0


def test_alignment_of_documents(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet").head(60)
    got = alignment.align_documents(spark.createDataFrame(docs[["doc_id", "text"]]), A, B).toPandas().sort_values("doc_id")
    want = plain_alignment(list(docs.sort_values("doc_id").text))
    assert [tuple(r)[1:] for r in got.itertuples(index=False)] == want


def test_minimal_perfect_hash(spark):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 46, 150_000))
    df = spark.createDataFrame(pd.DataFrame({"key": keys})).repartition(5)
    index = alignment.pair_hash(df, len(keys))
    slots = index.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and (index.keys[slots] == keys).all()
    assert (index.slots(keys[np.isin(keys + 1, keys, invert=True)] + 1) == -1).all()
    import pickle

    assert (pickle.loads(pickle.dumps(index)).slots(keys) == slots).all()
    assert (alignment.pair_hash(df.limit(0), 0).slots(keys) == -1).all()


# very long texts of 7 and 10


def test_long_chains_in_segments(monkeypatch):
    rng = np.random.default_rng(1)
    whole = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = whole(rng.random(8)), whole(rng.random((8, 8)) + 0.02), whole(rng.gamma(0.5, size=(8, 60)))
    sizes = [1, 5, 37, 0, 400, 64, 65, 1000, 16, 17]
    first = np.concatenate(([0], np.cumsum(sizes)))
    tokens = rng.integers(0, 60, first[-1])
    run = lambda: (hmm.log_likelihood(tokens, first, *model), *hmm.expected_counts(tokens, first, *model))
    want = run()
    monkeypatch.setattr(hmm, "_LONG", 1)
    for segment, together in ((16, 3), (64, 1000), (7, 2)):
        monkeypatch.setattr(hmm, "_SEGMENT", segment)
        monkeypatch.setattr(hmm, "_TOGETHER", together)
        assert all(np.allclose(a, b, rtol=1e-9) for a, b in zip(run(), want, strict=True))


def test_a_text_above_a_megabyte_scores_like_its_tokens(spark):
    text = " ".join(f"word{k % 977} of" for k in range(110_000))
    df = spark.createDataFrame([(1, text), (2, "word1 of word2"), (3, text[: 1 << 19])], "doc_id long, text string")
    got = {r.doc_id: r for r in hmm.score_documents(df, rounds=2, passes=1).collect()}
    assert got[1].n_tokens == 220_001 and np.isfinite([r.score for r in got.values()]).all()


def test_long_texts_measured_in_blocks(monkeypatch):
    rng = random.Random(3)
    parts = ["a", "b ", "c d ", "\n", "x y z w v u t s ", "é ", "AB!", "  ", "\n\n", "longlonglong", "a b\n", "| # "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in texts:
        base, features = boosted_rules.statistics(pa.array([text]))
        for size in (7, 40):
            b, f = boosted_rules.long_statistics(np.frombuffer(text.encode(), np.uint8), size)
            assert (b == base[0]).all() and np.allclose(f, features[0])
    big = "one two three four five six seven eight nine\n" * 60_000
    want = boosted_rules.statistics(pa.array([big]))
    monkeypatch.setattr(boosted_rules, "LONG", 1 << 40)
    assert (boosted_rules.statistics(pa.array([big]))[0] == want[0]).all()


def test_trees_walked_node_by_node():
    rng = np.random.default_rng(2)
    x = rng.random((300, len(boosted_rules.FEATURES)))
    trees = boosted_rules.fit(x, (x[:, 2] + x[:, 5] < 0.9).astype(float), list(boosted_rules.FEATURES.values()), trees=12)
    for row, score in zip(x, trees.score(x), strict=True):
        total = trees.start
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-12
