"""The pipeline against its stages done by hand, and the registered queries with SQL."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from cartolith.llm import boosted_rules, line_crf, mixing
from cartolith.llm.queries import table, tokenizer_path

from ..conftest import DATA
from ..test_queries import duck, values  # noqa: F401
from .test_operators import components_of


def test_stages_one_by_one(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns, labels = docs.columns, table(spark, DATA, "labels")
    outs = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, outs[-1], DATA).write.parquet(str(tmp_path / str(k)))
        outs.append(spark.read.parquet(str(tmp_path / str(k))))
    frames = [o.toPandas() for o in outs]
    assert all(o.columns == columns for o in outs[:-1])
    scores = line_crf.classify(docs, labels).toPandas()
    assert set(frames[1].doc_id) == set(scores[scores.predicted == 1].doc_id)
    verdicts = boosted_rules.judge(outs[1], labels, training=docs).toPandas()
    assert set(frames[2].doc_id) == set(verdicts[verdicts.kept].doc_id)
    groups = components_of(dict(zip(frames[2].doc_id, frames[2].text)), 5)
    assert set(frames[3].doc_id) == {i for i, (_, c) in groups.items() if i == c}
    copies = mixing.mix(outs[3]).toPandas()
    assert Counter(frames[4].doc_id) == Counter(dict(zip(copies.doc_id, copies.copies))) - Counter()
    library, texts = Tokenizer.from_file(tokenizer_path()), dict(zip(frames[4].doc_id, frames[4].text))
    for r in frames[5].itertuples():
        ids = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert len(frames[5]) == len(frames[4])
    run = corpus_pipeline.run(spark, DATA).toPandas()
    assert Counter(zip(run.doc_id, run.ids_sha256)) == Counter(zip(frames[5].doc_id, frames[5].ids_sha256))


def test_stages_of_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, DATA).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", ["op1_url_rules", "op4_segment_topk", "op12_conversation_trie"])
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    got, want = entry_module.queries()[name](spark, DATA).toPandas(), duck.sql(entry_module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


def test_every_operator_is_registered():
    names = entry_module.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_near_duplicates_on_the_table(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = entry_module.queries()["op2_minhash_join"](spark, DATA).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == components_of(dict(zip(docs.doc_id, docs.text)), 2)
