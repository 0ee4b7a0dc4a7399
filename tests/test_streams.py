"""The job stream with state of its own."""

import pytest
from pyspark.sql import functions as F

from cartolith.operators import documents
from cartolith.streaming import streams

from .test_core import rows

SCHEMA = "job_id string, seq long, ts long, repo_name string, status string, stage string, metrics string, error string, batch_id string, batch_index int, abort boolean"
EVENTS = [
    ("j", 3, 12, "r", "running", "B", None, None, None, None, None), ("k", 1, 5, None, "failed", None, None, "e", "b", 2, False),
    ("j", 1, 10, "r", "queued", "A", "m1", "bad", None, 4, None), ("j", 2, 11, None, "done", "A", None, None, None, None, True), ("k", 2, 6, "q", None, None, None, None, None, None, None),
]


@pytest.fixture
def rocksdb(spark):
    wanted = {"spark.sql.streaming.stateStore.providerClass": streams.ROCKSDB, "spark.sql.shuffle.partitions": "1"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def run(spark, tmp_path, batches, **options):
    """Rows that each batch of the stream gives; a batch is written, and the stream takes it in one step, one after the other."""
    source, seen = str(tmp_path / "in"), []

    def put(batch, _):
        seen.append([r.asDict(recursive=True) for r in batch.collect()])

    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = streams.job_state_stream(spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(source), **options)
        writer = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "check"))
        writer.trigger(once=True).start().awaitTermination(100)
    return seen


def test_batches_in_any_order_give_the_fold(spark, tmp_path, rocksdb):
    seen = run(spark, tmp_path, [EVENTS[:2], EVENTS[2:]])
    last = {r["job_id"]: r for batch in seen for r in batch}
    df = spark.createDataFrame(EVENTS, SCHEMA)
    names = ["job_id", "repo_name", "status", "current_stage", "error", "batch_id", "batch_index", "abort_requested", "created_at", "updated_at"]
    assert {tuple(r[c] for c in names) for r in last.values()} == rows(documents.fold_jobs(df).select(*names))
    stages = {(r["job_id"], s["stage"], s["status"], s["metrics"], s["error"]) for r in last.values() for s in r["stages"]}
    assert stages == rows(documents.fold_stages(df).select("job_id", "stage", "status", "metrics", "error"))
    assert not any(r["stalled"] for r in last.values())


def test_a_stalled_job_is_told_once(spark, tmp_path, rocksdb):
    other = [("x", n, 20 + n, None, "failed", None, None, None, None, None, None) for n in range(3)]
    seen = run(spark, tmp_path, [EVENTS[:1], other[:1], other[1:2], other[2:]], stall_ms=1)
    told = [r["job_id"] for batch in seen for r in batch if r["stalled"]]
    assert told == ["j"]


def test_messages_of_one_time_have_an_order(spark):
    m = spark.createDataFrame([(1, 5, "b", "x"), (1, 5, "a", "z"), (1, 5, "a", "y")], "conversation_id long, created_at long, role string, content string")
    assert [r.content for r in documents.list_messages(m, 1).collect()] == ["y", "z", "x"]
    assert [r.content for r in documents.first_messages(m, m.select("conversation_id").distinct(), 2).orderBy("pos").select(F.col("content")).collect()] == ["y", "z"]


def test_changed_versions_of_files_that_share_their_state(spark, tmp_path):
    import random

    from cartolith.streaming import streams

    schema = "namespace string, path string, sha1 string, updated_at long"
    rng, held, want, source, out = random.Random(2), {}, [], str(tmp_path / "in"), str(tmp_path / "out")
    for number in range(4):
        batch = [("n", f"f{rng.randrange(60)}", rng.choice("abc"), 10 * number + rng.randrange(-15, 10)) for _ in range(80)]
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        writer = streams.changed_versions(spark.readStream.schema(schema).parquet(source), buckets=3).writeStream.outputMode("append").format("parquet")
        streams.run_available(writer.option("path", out).option("checkpointLocation", str(tmp_path / "check")))
        for path in {b[1] for b in batch}:
            at, sha1 = max((b[3], b[2]) for b in batch if b[1] == path)
            before = held.get(path, (None, at))
            if at >= before[1]:
                held[path] = (sha1, at)
                want += [(path, sha1, at)] if sha1 != before[0] else []
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("path", "sha1", "updated_at").collect()) == sorted(want)
