"""The ten operators against brute force and libraries, with nulls, ties, repeated rows and empty tables."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartolith.llm import boosted_rules, hmm, line_crf, mixing, near_dedup, sharding, token_counts, trie_bpe, url_rules, vector_topk, words
from cartolith.llm.queries import tokenizer_path

from ..conftest import DATA

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATH = tokenizer_path()


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{DATA}/documents.parquet")


# words


@given(st.lists(st.text(alphabet="aB é\n\t漢 ", max_size=12), max_size=6))
def test_words_and_lines_of_any_texts(texts):
    data, offsets = words.buffers(pa.array(texts, pa.string()))
    found, lines = words.find_words(data, offsets), words.find_lines(data, offsets)
    at = lambda spans, i: [bytes(data[a:b]).decode() for a, b in zip(spans.starts[spans.first[i] : spans.first[i + 1]], spans.ends[spans.first[i] : spans.first[i + 1]])]
    for i, t in enumerate(texts):
        assert at(found, i) == WORD.findall(t)
        assert at(lines, i) == t.split("\n")


def test_hashes_follow_the_bytes():
    texts = ["Ab ab AB", "ab", "x" * (3 << 20) + " ab"]
    data, offsets = words.buffers(pa.array(texts))
    w = words.find_words(data, offsets)
    lower, exact = words.hash_spans(data, w.starts, w.ends, lower=True), words.hash_spans(data, w.starts, w.ends)
    assert len({*lower[[0, 1, 2, 3, 5]].tolist()}) == 1 and len({*exact.tolist()}) == 4
    shingles, begin = words.runs(lower, w.first, 2)
    assert np.diff(begin).tolist() == [2, 1, 1] and shingles[0] == shingles[1] != shingles[2]


def test_largest_and_sample(spark):
    from cartolith.llm import selection

    df = spark.range(1, 1001).withColumn("value", F.col("id") % 300 + 1)
    got = sorted(r.value for r in selection.largest(df, "value", 50).collect())
    every = sorted((r.value for r in df.collect()), reverse=True)
    assert 30 <= len(got) <= 50 and got == sorted(every[: len(got)]) and every[len(got)] < got[0]
    assert selection.largest(df, "value", 1000).count() == 1000 and selection.largest(df.limit(0), "value", 5).count() == 0
    few = selection.sample(df, F.col("id"), 20)
    assert [r.id for r in few.collect()] == [r.id for r in df.orderBy(F.xxhash64("id")).limit(20).collect()]
    assert selection.sample(df, F.col("id"), 2000).count() == 1000


# 1


def test_url_rules(spark):
    urls = [
        ("http://a.EXAMPLE.com/en/7817?x", "example.com/en/7", "allow"), ("https://x.com/en/9", "com/en/", "block"), ("http://example.net/de/8/1", "example.net/de/8", "block"), ("http://b.example.net/de/9", "net/de/", "block"),
        ("http://anexample.com/en/7", "com/en/", "block"), ("http://x.org/es", None, "allow"), ("http://x.org/ES/", None, "allow"), ("x.com/en/7", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("http://casino-win.example.org/fr/1", None, "block"),
        ("http://mycasino.example.org/fr/1", None, "allow"), ("http://responsible-gambling.org/x", None, "allow"), ("://com/en/", "com/en/", "block"), ("http://example.com?/en/7", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, (u, _, _) in enumerate(urls)] + [(None, "http://x.com/en/", "c", "c")], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in url_rules.filter_urls(df).collect()}
    for i, (u, rule, verdict) in enumerate(urls):
        assert (got[i].rule, got[i].verdict) == (rule, verdict), u
    assert got[0].host == "a.example.com" and got[0].path == "/en/7817" and got[14].path == "" and got[None].verdict == "block"
    assert url_rules.filter_urls(df.limit(0)).count() == 0


def test_contract_rules_word_by_word(spark):
    """The rules as the contract lists them; a URL under each one alone."""
    assert [(r.action, r.text) for r in url_rules.CONTRACT_RULES] == [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    urls = [("http://x.com/en/1", "com/en/", "block"), ("http://a.example.com/en/71", "example.com/en/7", "allow"), ("http://casino.x.net/de/1", "net/de/", "allow"), ("http://example.net/de/9", "net/de/", "allow"), ("http://b.example.net/de/8", "example.net/de/8", "block"), ("http://x.org/es/", "org/es/", "block")]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.filter_urls(df).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(urls)}


def test_index_runs_only_candidates():
    rules = [url_rules.pattern_rule("block", "^ads^banner^"), url_rules.pattern_rule("block", "track*er"), url_rules.host_rule("block", "bad.org", "")]
    index = url_rules.RuleIndex(rules, {"ads": 100, "banner": 2, "bad": 1, "org": 50})
    assert index.by_token == {"banner": [0], "bad": [2]} and index.always == [1]
    assert index.judge("http://x.y/ads/banner/1")[3] == "block" and index.judge("http://x.y/adsx/banner")[3] == "allow"
    assert index.judge("http://sub.bad.org")[3] == "block" and index.judge("http://bad.orgs/")[3] == "allow" and index.judge("http://a/trackXer")[3] == "block"


def test_thousands_of_rules_against_a_plain_loop(spark):
    rng = random.Random(12)
    names = [f"{a}{b}" for a in ("shop", "news", "img", "ad", "track", "blog", "cdn", "go") for b in range(40)]
    pick = lambda: rng.choice(names)
    rules, plain = {}, []
    for _ in range(1500):
        host, path, action = f"{pick()}.{rng.choice(('com', 'org', 'net'))}", rng.choice(("", f"/{pick()}/", f"/{pick()}", f"/{pick()}/{pick()}/")), rng.choice(("block", "allow"))
        if host + path not in rules:
            rules[host + path] = (host, path, action)
    patterns = {rng.choice((f"^{pick()}^{pick()}^", f"/{pick()}/*{pick()}^", f"{pick()}*.gif")): rng.choice(("block", "allow")) for _ in range(1500)}
    plain = [url_rules.host_rule(a, h, p) for h, p, a in rules.values()] + [url_rules.pattern_rule(a, p) for p, a in patterns.items()]
    urls = [f"https://{rng.choice(('', 'www.', 'a.b.'))}{pick()}.{rng.choice(('com', 'org', 'net', 'de'))}/{pick()}/{pick()}{rng.choice(('', '/', '.gif', '?q=' + pick()))}" for _ in range(300)]
    urls += ["http://x.com/" + "long/" * 40_000 + names[0], "http://" + "a." * 5000 + "shop1.com/", "http://shop1.com"]

    def expected(url):
        host, path = re.match("https?://([^/?#]*)([^?#]*)", url).groups()
        fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules.values() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return max(fits)[2:]
        expression = lambda p: "".join({"*": ".*", "^": "(?:^|[^a-z0-9])" if k == 0 else "(?:[^a-z0-9]|$)"}.get(c, re.escape(c)) for k, c in enumerate(p))
        actions = {a for p, a in patterns.items() if re.search(expression(p), url)}
        return None, "block" if actions == {"block"} else "allow"

    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), plain).collect()}
    assert got == {i: expected(u) for i, u in enumerate(urls)}
    index = url_rules.RuleIndex(plain, Counter(t for u in urls for t in set(re.findall("[a-z0-9]+", u))))
    for u in urls[:20]:
        index.judge(u)
    assert len(set(index._compiled).difference(index.always)) < len(plain) / 4  # of 20 URLs; rules without a token run for every one


# 2


def components_of(texts: dict, width: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in sets.items():
        for z in s:
            held[z].append(i)
    for i, s in sets.items():
        for k, n in Counter(k for z in s for k in held[z] if k < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[k]) - n):
                a, b = find(i), find(k)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_of_a_spread_out_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # many blocks
    rng = random.Random(1)
    base = [f"b{k}" for k in range(120)]
    texts = {k: edited(rng, base, rng.randrange(0, 22)) for k in range(150)}
    texts |= {200 + k: " ".join(f"u{k}x{j}" for j in range(rng.randrange(1, 40))) for k in range(60)}
    texts |= {300 + k: " ".join(base[:60]) + " " + " ".join(f"p{k}x{j}" for j in range(30)) for k in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, width=2).collect()}
    assert got == components_of(texts, 2)


def test_near_duplicates_of_words_that_weak_hashes_confuse(spark):
    texts = {k: " ".join([w, "x", w[::-1], *(f"y{j}" for j in range(3))]) for k, w in enumerate(THUE_MORSE)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=2).collect()}
    assert got == components_of(texts, 2)


def test_one_id_with_two_texts(spark):
    base = " ".join(f"b{k}" for k in range(60))
    rows = [(3, base), (5, base + " more"), (5, "another text of this id"), (5, "another text of this id"), (7, "seven words that no other row has at all"), (7, "seven words that no other row has at all!"), (8, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, width=2).collect()), key=str)
    assert got.count((5, 3, False)) == 1 and got.count((5, 5, True)) == 2
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one_of_each(df, width=2).collect()), key=str)
    assert [k for k in kept if k[0] not in (7,)] == [(3, base), (5, "another text of this id"), (8, ""), (9, None)] and len(kept) == 6 - (len([k for k in kept if k[0] == 7]) == 1)
    named = near_dedup.near_duplicates(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), width=2)
    assert sorted((r.doc_id, r.component_id) for r in named.collect()) == sorted((f"d{a}", f"d{b}") for a, b, _ in got)


def test_components_of_chains_and_stars(spark):
    from cartolith.llm.components import components

    chain = [(k, k + 1) for k in range(0, 300)]
    star = [(1000, k) for k in range(400, 2000) if k != 1000]
    rng = random.Random(3)
    pairs = [(rng.randrange(5000, 6000), rng.randrange(5000, 6000)) for _ in range(600)]
    edges = [(a, b) for a, b in chain + star + pairs if a != b]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}


def test_lookup_spreads_hot_keys(spark):
    from cartolith.llm.skew import look_up

    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 3).alias("j"), "id")
    table = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") % 3).alias("j"), (F.col("id") * 2).alias("x")).union(spark.createDataFrame([(7, 0, 14), (7, 1, 14)], "k long, j long, x long"))
    for keys in ("k", ["k", "j"]):
        for how in ("inner", "left", "left_semi"):
            one = table if keys != "k" else table.dropDuplicates(["k"]).drop("j")
            assert sorted(map(tuple, look_up(rows, one, keys, how).select("id").collect())) == sorted(map(tuple, rows.join(one, keys, how).select("id").collect()))


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = near_dedup.near_duplicates(odd, width=2).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == by[11].component_id == 1 and not by[2].kept and by[1].kept
    assert by[6].component_id == by[7].component_id == 6 and by[None].component_id is None and by[None].kept
    assert all(by[k].n_shingles == 0 and by[k].kept for k in (3, 4, 5)) and by[9].n_shingles == 1
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.keep_one_of_each(odd, width=2)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 8, 9, 10]


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert near_dedup.shared_sizes(sets[:4], sets[4:]).tolist() == want and near_dedup.shared_sizes(sets[:1], sets[4:]).tolist() == want[:1]


# 3 and 10


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(2)
    first = np.array([0, 1, 5, 8])
    odds, step = rng.normal(size=8), rng.normal(size=(2, 2))
    marginal, logz, pairs = line_crf.chains(odds, first, step)
    for c in range(3):
        a, b = first[c], first[c + 1]
        total, ones, seen = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(1 << (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            p = math.exp(sum((odds[a + k] if v else -odds[a + k]) / 2 for k, v in enumerate(y)) + sum(step[u, v] for u, v in zip(y, y[1:])))
            total += p
            ones += p * np.array(y)
            for u, v in zip(y, y[1:]):
                seen[u, v] += p
        assert np.allclose(marginal[a:b], ones / total) and np.isclose(logz[c], math.log(total)) and np.allclose(pairs[c], seen / total)


def line_score_of(text, weights):
    """Score of a text by the definitions, line by line."""
    rows, seen = [], set()
    for line in text.split("\n"):
        w, raw = WORD.findall(line), line.encode()
        some, letters = max(len(w), 1), sum(c.isascii() and c.isalpha() for c in line)
        symbols, pipes, bangs, upper = (sum(c in chars for c in line) for chars in ("#*$%&<>", "|", "!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        same = sum(a.translate(LOWER) == b.translate(LOWER) for a, b in zip(w, w[1:]))
        shout = upper / max(letters, 1)
        rows.append([
            min(symbols / some, 2), min(pipes / some, 1), min(bangs / some, 2), shout, sum(c in "0123456789" for c in line) / max(len(raw), 1), same / some, math.log1p(len(w)) / 5, min(len(raw) / some / 10, 3),
            line in seen and len(w) > 0, not w, line[-1:] in (".", "!", "?") and line != "", symbols > 0, pipes > 0, bangs > 0, shout > 0.5, same / some > 0.3, symbols / some > 0.3, len(w) < 3,
        ])
        seen.add(line)
    x, n = np.array(rows, float), len(rows)
    own, after, before = weights[: 3 * line_crf.OWN].reshape(3, -1)
    top, bottom, constant = weights[3 * line_crf.OWN : line_crf.WIDTH]
    odds = [x[k] @ own + (x[k - 1] @ after if k else top) + (x[k + 1] @ before if k + 1 < n else bottom) + constant for k in range(n)]
    move, total = np.exp(weights[line_crf.WIDTH :].reshape(2, 2)), 0.0
    forward, backward = [np.exp([-odds[0] / 2, odds[0] / 2])], [np.ones(2)]
    for o in odds[1:]:
        forward.append((forward[-1] / forward[-1].sum()) @ move * np.exp([-o / 2, o / 2]))
    for o in odds[:0:-1]:
        backward.insert(0, move @ (np.exp([-o / 2, o / 2]) * backward[0] / backward[0].sum()))
    sizes = [len(line.encode()) + 1 for line in text.split("\n")]
    for f, b, size in zip(forward, backward, sizes):
        total += size * (f * b)[1] / (f @ b)
    return total / sum(sizes)


THUE_MORSE = ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(n)) for n in (1024, 2048, 4096) for flip in (0, 1)]


def test_scores_follow_the_definitions(documents, monkeypatch):
    rng = np.random.default_rng(11)
    weights = rng.normal(size=line_crf.WIDTH + 4) / 4
    texts = [*documents.text[:40], "", "\n\n", "One line!", "a a a\nB|b\na a a\n#$%\nÜber 12.", "\n".join(THUE_MORSE), "".join(f"line {k % 50} | {k}\n" for k in range(900))]
    want = [line_score_of(t, weights) for t in texts]
    assert np.allclose(line_crf.score_texts(pa.array(texts), weights), want, atol=1e-5)
    monkeypatch.setattr(line_crf, "LONG_CHAIN", 3)  # chains in segments
    assert np.allclose(line_crf.score_texts(pa.array(texts), weights), want, atol=1e-5)
    monkeypatch.setattr(line_crf, "SLICE_BYTES", 64)  # texts in blocks of lines
    monkeypatch.setattr(words.slices, "__defaults__", (64,))
    assert np.allclose(line_crf.score_texts(pa.array(texts), weights), want, atol=1e-5)


def test_very_long_texts_take_little_memory():
    import tracemalloc

    weights = np.random.default_rng(3).normal(size=line_crf.WIDTH + 4) / 4
    for text in ("\n" * 5_000_000, "no line break " * 400_000):
        column = pa.array([text])
        tracemalloc.start()
        score = line_crf.score_texts(column, weights)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert 0 <= score[0] <= 1 and peak < 60 * len(text) + (200 << 20)


def test_windows_of_long_texts():
    text = np.frombuffer("\n".join(map(str, range(100))).encode(), np.uint8)
    got = [bytes(line_crf._window(text, draw, 7)).decode().split("\n") for draw in range(94)]
    assert got == [[str(k + j) for j in range(7)] for k in range(94)] and len(line_crf._window(text, 5, 100)) == len(text)


@pytest.mark.parametrize("operator", [line_crf.classify, boosted_rules.judge])
def test_held_out_quality(spark, operator):
    folder = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = operator(docs, labels).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean() > 0.97
    assert (good.score >= 0.3).mean() > 0.95 and (bad.score < 0.3).mean() > 0.7


def test_classifier_on_odd_rows(spark, odd, labels, none):
    got = line_crf.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.doc_id: r.held_out for r in got if r.doc_id} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got if r.doc_id}
    assert line_crf.classify(none, labels).count() == 0
    assert {r.score for r in line_crf.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert line_crf.reject_poor(odd, labels).columns == odd.columns


def test_training_ids_are_drawn_from_the_rows_at_hand(spark):
    from cartolith.llm.labelled import held_out, training_sample

    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    docs = labels.where(~held_out()).select("doc_id", F.lit("some text").alias("text"))
    first = training_sample(docs, labels, "quality", 50).select("doc_id")
    left = docs.join(first, "doc_id", "left_anti")  # as after a stage that removed all of the first draw
    again = training_sample(left, labels, "quality", 50).toPandas()
    assert first.count() == 100 and again.label.value_counts().to_dict() == {0: 50, 1: 50}
    one_bad = left.where("doc_id % 2 = 1").union(left.where("doc_id % 2 = 0").limit(1))
    assert training_sample(one_bad, labels, "quality", 50).toPandas().label.value_counts().to_dict() == {1: 50, 0: 1}


def statistics_of(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)]


def test_statistics_by_hand(documents):
    texts = [*documents.text, None, "", " \n ", "a\na\n a\n", "x y " * 20, "é漢 #|<\n" * 9, "\n".join(THUE_MORSE), " ".join(THUE_MORSE * 5)]
    base, features = boosted_rules.statistics(pa.array(texts, pa.string()))
    assert base.tolist() == [statistics_of(t) for t in texts] and np.isfinite(features).all()


def test_trees_are_monotonic():
    rng = np.random.default_rng(5)
    x = rng.random((800, len(boosted_rules.FEATURES)))
    y = (x[:, 2] + 0.3 * np.sin(20 * x[:, 2]) + 0.2 * rng.normal(size=800) < 0.5).astype(float)
    signs = list(boosted_rules.FEATURES.values())
    trees = boosted_rules.fit(x, y, signs, trees=25)
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.8
    for f in np.flatnonzero(signs):
        probe = np.repeat(x[:20], 30, axis=0)
        probe[:, f] = np.tile(np.linspace(-0.5, 1.5, 30), 20)
        assert (np.diff(trees.score(probe).reshape(20, 30), axis=1) <= 1e-12).all()


def test_rules_on_odd_rows(spark, odd, labels, none):
    got = boosted_rules.judge(odd, labels).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        assert [r[c] for c in boosted_rules.BASE] == statistics_of(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (not r.kept or not r.base_failed)
    assert boosted_rules.judge(none, labels).count() == 0
    assert all(r.kept == (not r.base_failed) for r in boosted_rules.judge(odd, labels.limit(0)).collect())
    assert boosted_rules.reject_rule_breakers(odd, labels).columns == odd.columns


# 4


def best_of(q, c, q_ids, ids, k):
    return {a: set(heapq.nsmallest(k, ((-min(max(sum(int(x) * int(y) for x, y in zip(q[a], c[i])), 1 - (1 << 63)), (1 << 63) - 1), int(ids[i]), i) for i in range(len(ids)) if q_ids[a] != ids[i]))) for a in range(len(q_ids))}


def found_of(at, found, score):
    got = defaultdict(list)
    for a, i, s in zip(at.tolist(), found.tolist(), score.tolist()):
        got[a].append((-s, i))
    return {a: sorted(v) for a, v in got.items()}


@pytest.mark.parametrize("dims", [1, 7, 64])
def test_top_products_against_all(dims):
    rng = np.random.default_rng(dims)
    q, c = rng.integers(-40, 40, (30, dims)).astype(float), rng.integers(-40, 40, (1600, dims)).astype(float)
    c[:50] = q[:1]  # ties
    q_ids, ids = np.arange(30), rng.permutation(1600)
    want = {a: sorted((s, i) for s, i, _ in v) for a, v in best_of(q, c, q_ids, ids, 5).items()}
    assert found_of(*vector_topk.top_products(q_ids, q, ids, c, 5)) == want


def test_clustered_vectors_are_pruned():
    rng = np.random.default_rng(8)
    centres = np.repeat(rng.normal(size=(40, 8)), 8, axis=1) * 200  # coarse shapes
    c = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 64)) * 8)
    q, ids, q_ids, work = c[:60].copy(), np.arange(4000), np.arange(60), {}
    got = found_of(*vector_topk.top_products(q_ids, q, ids, c, 5, work))
    products = (q @ c.T).astype(int)
    assert got == {a: sorted(heapq.nsmallest(5, ((-int(products[a, i]), i) for i in range(4000) if i != a))) for a in range(60)}
    assert work["pairs"] == 60 * 3999 and work["products"] < work["pairs"] / 4 and work["live_4"] <= work["live_8"] <= work["live_16"] < work["pairs"]


def test_large_components_are_exact():
    rng = np.random.default_rng(6)
    c = np.floor(rng.normal(size=(50, 3)) * 100)
    c[3], c[4], c[5], c[6] = (2.0**53, 1, 0), (0, 3, 2), (2.0**60, 2.0**60, 2.0**60), (1e300, 0, 0)
    q_ids, ids = np.arange(8), np.arange(50)
    want = {a: sorted((s, i) for s, i, _ in v) for a, v in best_of(c[:8], c, q_ids, ids, 5).items()}
    assert found_of(*vector_topk.top_products(q_ids, c[:8], ids, c, 5)) == want


def test_top_k_on_odd_rows(spark):
    rows = [(0, [0.5, 0.25], "x"), (50, [0.5, 0.25], "x"), (1, [0.1, None], "x"), (2, None, "x"), (3, [float("nan"), 1.0], "x"), (4, [float("inf"), 1.0], "x"), (5, [1.0, 1.0], "x"), (5, [1.0, 1.0], "x"), (6, [1.0], "x"), (None, [9.0, 9.0], "x"), (7, [-0.001, 0.0], "x"), (100, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vector_topk.top_k(df, F.col("vec_id") % 50 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 49152), (0, 2, 5, 49152), (0, 3, 50, 20480), (50, 1, 5, 49152), (50, 2, 5, 49152), (50, 3, 0, 20480)]
    assert vector_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    small = vector_topk.top_k(df, F.col("vec_id") % 50 == 0, 3, query_block=1, candidate_block=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in small] == got
    large = spark.createDataFrame([(0, [1e12, 1.0]), (1, [3.0, 2.0])], "vec_id long, embedding array<double>")
    assert vector_topk.top_k(large, F.col("vec_id") == 0, 1).first().score == int(256e12) * 768 + 256 * 512
    huge = spark.createDataFrame([(0, [2.0**45, 1.0]), (1, [2.0**-8, 1.0]), (2, [1e308, 1.0]), (3, [0.0, 1e30])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vector_topk.top_k(huge, F.col("vec_id") == 0).collect()] == [(3, (1 << 63) - 1), (1, (1 << 53) + 65536)]


# 5


def one_by_one(sizes, shards):
    """Loads after giving each group, largest first, to the least-loaded shard."""
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += size
    return loads


@given(st.lists(st.integers(1, 30) | st.sampled_from([7, 500, 501]), max_size=300), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_schedule_gives_each_group_to_the_least_loaded_shard(sizes, shards):
    counted = sorted(Counter(sizes).items(), reverse=True)
    given_ = sharding.schedule(counted, shards)
    assert [sum(g) for g in given_] == [c for _, c in counted]
    assert [sum(g[j] * size for g, (size, _) in zip(given_, counted)) for j in range(shards)] == one_by_one(sizes, shards)


def test_many_equal_groups_take_no_time():
    given_ = sharding.schedule([(100, 10**9), (16, 10**9 + 7)], 40)
    assert sum(given_[0]) == 10**9 and max(given_[1]) - min(given_[1]) <= 1


@pytest.mark.parametrize("ranked", [1 << 15, 2])
def test_shards(spark, odd, none, ranked, monkeypatch):
    monkeypatch.setattr(sharding, "_RANKED", ranked)
    got = sharding.shard_documents(odd, 3).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id in (1, None)}) == 1 and {r.law for r in got} == {"bytes"}
    assert sharding.shard_documents(none).count() == 0


def test_shards_are_near_equal(spark, documents):
    got = sharding.shard_documents(spark.read.parquet(f"{DATA}/documents.parquet"), 8).toPandas()
    groups = Counter()
    for t in documents.text:
        groups[t] += len(t.encode()) + 16
    assert sorted(got.groupby("shard")["size"].sum()) == sorted(one_by_one(groups.values(), 8))
    loads = got.groupby("shard")["size"].sum()
    assert (got.merge(documents, on="doc_id").groupby("text").shard.nunique() == 1).all()


# 6 and 8


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(PATH)


@pytest.fixture(scope="module")
def trie():
    return trie_bpe.TrieBPE(PATH)


TEXTS = st.text(max_size=60) | st.text(alphabet="aetr '\n\t  <|endoftext|>0é漢", max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", " the", "don't", "aaaa", "  ", "\r\n", "漢字", "🙂", "12345", "====="]), max_size=12).map("".join)


@given(TEXTS)
@settings(max_examples=400, deadline=None)
def test_tokens_as_the_library_gives_them(library, counter, trie, text):
    text = text.encode("utf-8", "replace").decode()
    ids = library.encode(text, add_special_tokens=False).ids
    assert counter.count(text) == len(ids)
    packed = trie.encode_batch([text])[0]
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert trie.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_every_vocabulary_string_as_a_word(library, trie):
    back = {c: b for b, c in token_counts.byte_alphabet().items()}
    texts = [bytes(back[c] for c in t).decode("utf-8", "ignore") for t in list(library.get_vocab())[::7]]
    assert [np.frombuffer(b, "<u4").tolist() for b in trie.encode_batch(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_are_proved(library, counter):
    assert len(counter.whole) > 40000 and all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in list(counter.whole)[::50])


def test_very_long_texts(library, counter, trie, monkeypatch):
    text = "".join(f"Lorem <|endoftext|> ipsum{k % 977}  dolor\n" for k in range(40_000))  # more than a MiB
    assert len(text) > token_counts._LONG
    ids = library.encode(text, add_special_tokens=False).ids
    assert counter.count(text) == len(ids) and np.frombuffer(trie.encode_batch([text])[0], "<u4").tolist() == ids
    word = "x" * (3 << 19)
    assert counter.count(word) == len(library.encode(word, add_special_tokens=False).ids)
    text = text[:50_000]
    ids = library.encode(text, add_special_tokens=False).ids
    tries = []
    walk = trie_bpe.TrieBPE.encode_words
    monkeypatch.setattr(trie_bpe.TrieBPE, "encode_words", lambda self, words_: (tries.append(len(words_)), walk(self, words_))[1])
    monkeypatch.setattr(token_counts, "_LONG", 10)
    monkeypatch.setattr(token_counts, "_PIECE", 700)
    monkeypatch.setattr(trie_bpe, "_STRETCH", 1500)
    fresh = trie_bpe.TrieBPE(PATH)
    assert counter.count(text) == len(ids) and np.frombuffer(fresh.encode_batch([text])[0], "<u4").tolist() == ids
    assert max(tries) > 100  # words of a long text share a trie
    monkeypatch.setattr(trie_bpe, "_KEPT", 1)  # what is kept goes again and again
    assert np.frombuffer(fresh.encode_batch([text, "other words here"])[0], "<u4").tolist() == ids


def test_token_operators_on_odd_rows(odd, none, library):
    texts = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    got = token_counts.count_tokens(odd, PATH).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == texts and all(r.over_limit == (r.n_tokens > 1024) for r in got)
    coded = trie_bpe.encode_documents(odd, PATH).collect()
    want = Counter((r.doc_id, hashlib.sha256(np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest(), r.text or "") for r in odd.collect())
    assert Counter((r.doc_id, hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in coded) == want
    assert token_counts.count_tokens(none, PATH).count() == trie_bpe.encode_documents(none, PATH).count() == 0


# 7


def test_forward_and_counts_against_all_paths():
    rng = np.random.default_rng(4)
    states, classes = 3, 5
    start, move, emit = rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes), states)
    tokens, first = np.array([0, 3, 1, 4, 2, 2], np.int16), np.array([0, 1, 5, 6])
    want = np.zeros(3)
    starts, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
    for c in range(3):
        seq = tokens[first[c] : first[c + 1]]
        paths = list(np.ndindex(*(states,) * len(seq)))
        weight = [start[p[0]] * emit[p[0], seq[0]] * math.prod(move[a, b] * emit[b, x] for a, b, x in zip(p, p[1:], seq[1:])) for p in paths]
        want[c] = math.log10(sum(weight))
        for p, w in zip(paths, np.array(weight) / sum(weight)):
            starts[p[0]] += w
            for a, b in zip(p, p[1:]):
                moves[a, b] += w
            for s, x in zip(p, seq):
                emissions[s, x] += w
    assert np.allclose(hmm.log_likelihood(tokens, first, start, move, emit), want)
    for kind, near in ((float, 1e-8), (np.float32, 1e-4)):
        for got, expected in zip(hmm.expected_counts(tokens, first, start, move, emit, kind), (starts, moves, emissions, want.sum())):
            assert np.allclose(got, expected, rtol=near)


def test_long_sequences_keep_their_probability():
    rng = np.random.default_rng(9)
    start, move, emit = rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.full(900, 0.2), 4) + 1e-9
    sizes = np.array([40_000, 1, 0, 17, 800, 3])
    tokens, first = rng.integers(0, 900, sizes.sum()).astype(np.int32), np.concatenate(([0], np.cumsum(sizes)))
    want = []
    for a, b in zip(first[:-1], first[1:]):
        state, total = start, 0.0
        for t in range(a, b):
            state = (state if t == a else state @ move) * emit[:, tokens[t]]
            total += math.log10(state.sum())
            state = state / state.sum()
        want.append(total)
    assert np.allclose(hmm.log_likelihood(tokens, first, start, move, emit), want, rtol=1e-10)
    whole, single = hmm.expected_counts(tokens, first, start, move, emit), hmm.expected_counts(tokens, first, start, move, emit, np.float32)
    assert np.isclose(whole[3][0], sum(want)) and np.isclose(whole[2].sum(), sizes.sum()) and np.isclose(whole[1].sum(), (sizes - 1).clip(0).sum())
    assert all(np.allclose(a, b, rtol=1e-3, atol=1e-3) for a, b in zip(whole, single))


def test_end_token_is_known_however_many_words_there_are(spark):
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 10]
    held = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = spark.createDataFrame([(ids[0], " ".join(f"w{k}" for k in range(140_000))), (held, "w5 w6 nowhere")], "doc_id long, text string")
    r = hmm.score_documents(docs, rounds=1, passes=0).where(F.col("doc_id") == held).first()
    n, v = 140_001, 140_001
    assert (r.n_tokens, r.n_known, r.train_tokens) == (4, 3, n)
    assert math.isclose(r.base_score, 3 * math.log10(1.1 / (n + 0.1 * (v + 1))) + math.log10(0.1 / (n + 0.1 * (v + 1))), rel_tol=1e-12)


def test_language_model(spark, documents):
    got = hmm.score_documents(spark.read.parquet(f"{DATA}/documents.parquet"), rounds=6).toPandas()
    tokens = {i: [*WORD.findall(t.translate(LOWER)), "\n"] for i, t in zip(documents.doc_id, documents.text)}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in got.itertuples():
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in counts for w in ws), n, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_score_is_chain_times_share_of_class(spark, documents, monkeypatch):
    monkeypatch.setattr(hmm, "TOP_WORDS", 50)
    monkeypatch.setattr(hmm, "FREQUENT", 300)  # so some words are in the chain alone, some shared out where they lie, some after a join
    models = []
    whole = hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda *args: (models.append(whole(*args)), models[-1])[1])
    got = hmm.score_documents(spark.read.parquet(f"{DATA}/documents.parquet"), rounds=2, passes=0).toPandas()
    start, move, emit = models[-1][0]
    tokens, shapes, hashes = {}, {"\n": -1}, {}
    for i, t in zip(documents.doc_id, documents.text):
        words_ = WORD.findall(t.translate(LOWER))
        tokens[i] = [*words_, "\n"]
        _, _, h, shape, _ = next(hmm._words(pa.array([" ".join(words_)])))
        hashes |= zip(words_, h.tolist())
        shapes |= zip(words_, shape.tolist())
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws[:-1])
    ranked = sorted(counts, key=lambda w: (-counts[w], hashes[w]))
    own = {w: k + 1 for k, w in enumerate(ranked[: max(50, sum(c >= hmm.OWN_COUNT for c in counts.values()))])} | {"\n": 0}
    shape_tokens, shape_words = Counter(), Counter()
    for w in counts:
        if w not in own:
            shape_tokens[shapes[w]] += counts[w]
            shape_words[shapes[w]] += 1
    for r in got.itertuples():
        state, want = None, 0.0
        for w in tokens[r.doc_id]:
            state = (start if state is None else state @ move) * emit[:, own[w] if w in own else len(own) + shapes[w]]
            want += math.log10(state.sum())
            state = state / state.sum()
            if w not in own:
                want += math.log10((counts[w] + 0.1) / (shape_tokens[shapes[w]] + 0.1 * (shape_words[shapes[w]] + 1)))
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_classes_share_their_tokens_out():
    counts = np.array([5, 3, 1])
    lexicon = hmm.Lexicon(np.array([30, 10, 20]), counts, 9, 3)
    lexicon.shape_total[7], lexicon.shape_words[7] = 9, 3
    known, unknown = 10 ** lexicon.inner(counts, np.full(3, 7)), 10 ** lexicon.inner(np.zeros(1), np.array([7]))
    assert math.isclose(known.sum() + unknown.sum(), 1)
    assert sorted(lexicon.classes.tolist()) == [1, 2, 3] and lexicon.find(np.array([10, 11]))[1].tolist() == [True, False]
    model = hmm.reestimated(np.ones(2), np.ones((2, 2)), np.zeros((2, hmm.CLASSES)), np.full(hmm.CLASSES, 0.01))
    assert all(np.allclose(x.sum(axis=-1), 1) for x in model)


def test_every_training_row_shapes_the_states_in_every_pass(spark, monkeypatch):
    seen = []
    whole = hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda encoded, *rest: (seen.append(encoded.count()), whole(encoded, *rest))[1])
    docs = spark.createDataFrame([(i, ("a b " if i % 2 else "c d ") * 2000) for i in range(12)], "doc_id long, text string")  # no row has 3000 tokens or fewer
    training = sum(zlib.crc32(str(i).encode()) % 10 > 0 for i in range(12))
    got = hmm.score_documents(docs).toPandas()
    assert len(seen) > 2 and set(seen) == {training}
    assert (got.score > got.base_score).all()


def test_frequent_words_have_classes_of_their_own():
    n = 40_000
    lexicon = hmm.Lexicon(np.arange(n), np.full(n, hmm.OWN_COUNT), n * hmm.OWN_COUNT, n)
    assert sorted(lexicon.classes.tolist()) == list(range(1, n + 1)) and len(lexicon.totals()) == 1 + n + hmm.SHAPES


@pytest.mark.parametrize("n", [32_000, 40_000])  # shapes begin within 16 bits and end beyond them; all lie beyond
def test_shapes_follow_however_many_words_of_their_own(spark, monkeypatch, n):
    monkeypatch.setattr(hmm, "OWN_COUNT", 1)
    models, whole = [], hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda *args: (models.append(whole(*args)), models[-1])[1])
    learnt, held = (next(i for i in range(99) if (zlib.crc32(str(i).encode()) % 10 == 0) == out) for out in (False, True))
    unknown = [f"{a}nowhere{b}" for a in "bdfhjl" for b in "acegikmo"]
    docs = spark.createDataFrame([(learnt, " ".join(f"w{k}" for k in range(n))), (held, " ".join(unknown))], "doc_id long, text string")
    r = hmm.score_documents(docs, rounds=1, passes=0).where(F.col("doc_id") == held).first()
    start, move, emit = models[-1][0]
    assert emit.shape[1] == 1 + n + hmm.SHAPES
    _, _, _, shapes, _ = next(hmm._words(pa.array([" ".join(unknown)])))
    assert n > 32_767 or (n + 1 + shapes.astype(int)).max() > 32_767
    state, want = None, 0.0
    for shape in shapes.astype(int):  # -1: the end token; no training word has a shape, so unknown words have all of their classes
        state = (start if state is None else state @ move) * emit[:, 0 if shape < 0 else 1 + n + shape]
        want += math.log10(state.sum())
        state = state / state.sum()
    assert r.n_known == 1 and math.isclose(r.score, want, rel_tol=1e-9)


def test_language_model_of_a_few_words(spark):
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(["a b a", "b c", "a a d", "c"] * 3)], "doc_id long, text string")
    got = hmm.score_documents(docs).toPandas()
    assert (got.score < 0).all() and np.isfinite(got.score).all()


def test_language_model_on_odd_rows(odd, none):
    got = hmm.score_documents(odd, rounds=2).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert hmm.score_documents(none).count() == 0
    only_held = odd.where("doc_id = 10").withColumn("doc_id", F.lit(4).cast("long"))
    alone = hmm.score_documents(only_held.withColumn("doc_id", F.lit(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)).cast("long"))).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and math.isfinite(alone.score)


# 9


def targets_of(sizes, total, weights=(1, 2, 3), limit=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full = {s: weights[i % len(weights)] for i, s in enumerate(order)}, set()
    while True:
        rest, open_ = total - sum(limit * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        share = {s: limit * sizes[s] if s in full else rest * weight[s] / open_ for s in order}
        over = {s for s in order if s not in full and share[s] > limit * sizes[s]}
        if not over:
            return share
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_stop_at_the_limit(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{rng.randrange(10**6)}": int(rng.paretovariate(0.7)) for _ in range(50)} | {None: 7, "empty": 0}
    total = sum(sizes.values())
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), total)
    want = targets_of(sizes, total)
    assert {r.source: r.target for r in got.collect()} == pytest.approx(want) and math.isclose(sum(want.values()), total)
    assert {r.target for r in mixing.targets(spark.createDataFrame([("a", 0)], "source string, size long"), 0).collect()} == {0.0}


def test_mix_of_thousands_of_sources(spark):
    rows = [(i, "w " * (1 + i % 5), [f"s{i % 3000}", *([f"s{(i + 1) % 3000}"] if i % 3000 < 20 else [])]) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, in array<string>"), F.col("in")).toPandas()
    assert len(got) == 6000 and (got.taken <= 3 * got["size"]).all()
    sizes = Counter()
    for i, t, names in rows:
        for s in names:
            sizes[s] += len(t.split())
    want = targets_of(sizes, sum(len(t.split()) for _, t, _ in rows))
    taken = dict(zip(got.doc_id, got.taken))
    for k in range(100, 3000):  # sources of one pattern
        assert abs(sum(taken[i] for i in (k, k + 3000)) - want[f"s{k}"]) <= 3


def test_flow_is_cheapest():
    # two patterns: one of both sources, one of the second only
    sent = mixing.min_cost_flow([[(10, 0), (10, 1), (10, 4)], [(10, 0), (10, 1), (10, 4)]], [[0, 1], [1]], [15, 15])
    assert sum(sent) == 30 and sum(max(0, s - 10) for s in sent) == 10  # all of both first passes
    assert mixing.min_cost_flow([[(10, 0), (10, 1)], [(5, 0), (5, 1)]], [[0], [0]], [15]) == [10, 5]


def test_mix(spark, documents):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    rows = got.merge(documents[["doc_id", "source", "text"]], on="doc_id")
    assert (rows["size"] == rows.text.map(lambda t: len(WORD.findall(t)))).all() and (rows.taken <= 3 * rows["size"]).all()
    for _, g in rows.groupby("source"):
        assert g.source_size.iloc[0] == g["size"].sum() and abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1
    assert math.isclose(rows.groupby("source").target.first().sum(), rows["size"].sum())


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 3 * r["size"] for r in got) and {r.doc_id for r in got if r["size"] == 0} == {3, 4, 5}
    assert mixing.mix(none).count() == 0
    taken = mixing.take(odd)
    assert taken.columns == odd.columns and taken.count() == sum(r.copies for r in got)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("in", F.when(F.col("doc_id") < 100, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))))
    got = mixing.mix(df, F.col("in"), weights=(1, 1)).toPandas()
    first = got[got.doc_id < 100]
    assert got.taken.sum() == pytest.approx(2000, abs=20) and first.taken.sum() >= 1000 and got.copies.max() <= 2


def test_mix_cuts_each_source_at_its_place_in_the_seeded_order(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 7).cast("int"))).alias("text"), F.when(F.col("id") % 3 > 0, "a").alias("source"))
    rows = mixing._measured(df, None, 42)("doc_id")
    got = mixing.mix(df).join(rows.select("doc_id", "draw", "pattern"), "doc_id").toPandas()
    got["place"] = got["draw"].astype("int64").to_numpy().view("uint64")
    for _, part in got.groupby("pattern"):
        part = part.sort_values("place")
        words, rest = part["size"].sum(), round(part["target"].iloc[0]) % part["size"].sum()
        extra = (part["size"].cumsum() - part["size"] / 2 <= rest) & (rest > 0)
        assert (part["copies"] == round(part["target"].iloc[0]) // words + extra).all()


def test_mix_of_rows_of_no_source(spark):
    df = spark.createDataFrame([(1, "a b c", ["x"]), (2, "a b", None), (3, "a", []), (4, None, None), (5, "a b", [None])], "doc_id long, text string, in array<string>")
    got = {r.doc_id: (r.source_size, r.target, r.copies) for r in mixing.mix(df, F.col("in")).collect()}
    assert [got[k] for k in (2, 3, 4)] == [(0, 0.0, 0)] * 3
    assert got[1][0] == 3 and got[5][0] == 2 and got[1][2] > 0 and got[5][2] > 0
    assert mixing.take(df, F.col("in")).where("doc_id in (2, 3, 4)").count() == 0
