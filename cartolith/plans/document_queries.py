"""Queries of documents, jobs and conversations, and of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as docs
from ..operators import payloads
from ..operators.context import numbered_within
from ..storage import new_folder
from ..streaming import streams
from . import bindings as b
from .registry import query


@query("d1_potential_entry_points", f"WITH {b.DOCS} SELECT repo_id, file_path AS path FROM docs WHERE document_type = 'POTENTIAL_ENTRY_POINTS'")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return docs.potential_entry_points(b.model_documents(spark, d))


def _repos(spark: SparkSession, d: str) -> DataFrame:
    return b.files(spark, d).select(F.col("folder").alias("repo_id")).distinct()


@query("d2_repo_summary", f"WITH {b.FILES} SELECT DISTINCT folder AS repo_id, CASE WHEN folder < 'src15' THEN 'summary of ' || folder ELSE '' END AS summary FROM files")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return docs.repo_summaries(_repos(spark, d), b.model_documents(spark, d))


@query(
    "d3_brief_file_overviews",
    f"WITH {b.DOCS}, asked AS (SELECT folder AS repo_id, path, CAST(row_number() OVER (PARTITION BY folder ORDER BY path DESC) - 1 AS BIGINT) AS pos FROM files) SELECT a.repo_id, a.pos, a.path, d.data AS brief FROM asked a JOIN docs d ON d.repo_id = a.repo_id AND d.file_path = a.path AND d.document_type = 'BRIEF_FILE_OVERVIEW' AND d.data <> ''",
)
def d3(spark: SparkSession, d: str) -> DataFrame:
    paths = b.files(spark, d).select(F.col("folder").alias("repo_id"), "path")
    asked = numbered_within(paths, "repo_id", (F.desc("path"),), "pos").withColumn("pos", F.col("pos") - 1)
    return docs.briefs_in_order(asked, b.model_documents(spark, d))


@query("d4_brief_file_overview", f"WITH {b.DOCS} SELECT f.folder AS repo_id, f.path, coalesce(d.data, '') AS brief FROM files f LEFT JOIN docs d ON d.file_path = f.path AND d.document_type = 'BRIEF_FILE_OVERVIEW'")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return docs.brief_or_empty(b.files(spark, d).select(F.col("folder").alias("repo_id"), "path"), b.model_documents(spark, d))


@query("d5_critical_file_paths", f"WITH {b.DOCS} SELECT repo_id, file_path AS path FROM docs WHERE document_type = 'BRIEF_FILE_OVERVIEW'")
def d5(spark: SparkSession, d: str) -> DataFrame:
    return docs.critical_paths(b.model_documents(spark, d))


@query("d6_list_conversations", f"WITH {b.CHATS} SELECT conversation_id, repo_id, updated_at FROM heads ORDER BY updated_at DESC, conversation_id LIMIT 20 OFFSET 10")
def d6(spark: SparkSession, d: str) -> DataFrame:
    return docs.list_conversations(b.conversations(spark, d), limit=20, offset=10)


@query("d7_conversation_messages", f"WITH {b.CHATS} SELECT conversation_id, CAST(pos AS INTEGER) AS pos, role, content FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS pos FROM msgs) WHERE pos <= 3")
def d7(spark: SparkSession, d: str) -> DataFrame:
    return docs.first_messages(b.messages(spark, d), b.conversations(spark, d), 3).select("conversation_id", "pos", "role", "content")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return docs.fold_jobs(b.job_events(spark, d))


@query("d8_list_jobs", f"WITH {b.JOBS} SELECT job_id, repo_name, status, updated_at FROM jobs WHERE status = 'running' ORDER BY updated_at DESC, created_at DESC, job_id LIMIT 20 OFFSET 5")
def d8(spark: SparkSession, d: str) -> DataFrame:
    return docs.list_jobs(_jobs(spark, d), limit=20, skip=5, status="running").select("job_id", "repo_name", "status", "updated_at")


@query("d8_count_jobs", f"WITH {b.JOBS} SELECT count(*) AS total FROM jobs WHERE status = 'running'")
def d8b(spark: SparkSession, d: str) -> DataFrame:
    return docs.count_jobs(_jobs(spark, d), status="running")


@query("d9_job_status", f"WITH {b.EVENTS} SELECT job_id, stage, CASE WHEN stage = 'PRECHECK' THEN 'total_tokens' ELSE m END AS metric, arg_max(metrics, seq) AS value FROM ev, (VALUES ('total_tokens'), ('other')) v(m) WHERE NOT (stage = 'PRECHECK' AND m = 'other') GROUP BY job_id, stage, m")
def d9(spark: SparkSession, d: str) -> DataFrame:
    stages = docs.fold_stages(b.job_events(spark, d)).withColumn("metrics", F.create_map(F.lit("total_tokens"), "metrics", F.lit("other"), "metrics"))
    packed = stages.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", F.struct("status", "metrics").alias("s")))).alias("stages"))
    shown = docs.job_statuses(packed).select("job_id", F.explode("stages").alias("stage", "s"))
    return shown.select("job_id", "stage", F.explode("s.metrics").alias("metric", "value"))


@query("d10_batch_jobs", f"WITH {b.JOBS} SELECT job_id, batch_index FROM jobs WHERE batch_id = 'b3'")
def d10(spark: SparkSession, d: str) -> DataFrame:
    return docs.batch_jobs(_jobs(spark, d), "b3").select("job_id", "batch_index")


@query("d11_repo_states", f"WITH {b.JOBS}, repos AS (SELECT DISTINCT source AS repo_id FROM documents) SELECT repo_id, repo_id < 'src3' AS ingested, repo_id IN (SELECT repo_name FROM jobs WHERE status = 'running') AS being_ingested FROM repos")
def d11(spark: SparkSession, d: str) -> DataFrame:
    repos = _repos(spark, d)
    return docs.repo_states(repos, repos.where("repo_id < 'src3'"), _jobs(spark, d))


@query("d12_ingested_repos", "SELECT DISTINCT source AS repo_id FROM documents")
def d12(spark: SparkSession, d: str) -> DataFrame:
    repos = _repos(spark, d)
    return docs.ingested_repos(repos.union(repos.select(F.lit("")).distinct()))


@query("d13_add_ingested_repo", "SELECT DISTINCT source AS repo_id, CASE WHEN source < 'src3' THEN 'old' ELSE 'new' END AS job_id FROM documents")
def d13(spark: SparkSession, d: str) -> DataFrame:
    repos = _repos(spark, d)
    return docs.add_ingested(repos.where("repo_id < 'src3'").withColumn("job_id", F.lit("old")), repos.withColumn("job_id", F.lit("new")))


@query("d14_fold_job_events", f"WITH {b.JOBS} SELECT * FROM jobs")
def d14(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d)


_stages = f"WITH {b.EVENTS} SELECT job_id, stage, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(metrics, seq) AS metrics, arg_max(error, seq) FILTER (error IS NOT NULL) AS error FROM ev GROUP BY job_id, stage"


@query("d14_fold_stages", _stages)
def d14b(spark: SparkSession, d: str) -> DataFrame:
    jobs = docs.with_stages(_jobs(spark, d), docs.fold_stages(b.job_events(spark, d)))
    return jobs.select("job_id", F.explode("stages").alias("stage", "state")).select("job_id", "stage", "state.*")


# each row: what is set, the leaf below it, its JSON text
_SETS = f"""{b.EVENTS}, typed AS (SELECT ev.*, e.event_type, e.user_id, CAST(json_extract(e.props, '$.k') AS VARCHAR) AS k FROM ev JOIN events e ON ev.seq = e.event_id WHERE ev.seq % 41 <> 0),
given AS (
  SELECT job_id, seq, ['last_' || event_type] AS place, ['last_' || event_type] AS path, CAST(seq AS VARCHAR) AS value FROM typed
  UNION ALL SELECT job_id, seq, ['stages', stage], ['stages', stage, 'status'], CASE WHEN status IS NULL THEN 'null' ELSE '"' || status || '"' END FROM typed WHERE event_type <> 'purchase'
  UNION ALL SELECT job_id, seq, ['stages', stage], ['stages', stage, 'metrics', 'k'], k FROM typed WHERE event_type <> 'purchase'
  UNION ALL SELECT job_id, seq, ['stages', stage], ['stages', stage, 'metrics', 'total_tokens'], CAST(seq % 1000 AS VARCHAR) FROM typed WHERE event_type <> 'purchase' AND seq % 3 = 0
  UNION ALL SELECT job_id, seq, ['stages', stage, 'metrics', 'paid'], ['stages', stage, 'metrics', 'paid'], '[' || k || ',' || seq || ']' FROM typed WHERE event_type = 'purchase'
  UNION ALL SELECT job_id, seq, ['stages'], ['stages'], 'null' FROM typed WHERE seq % 701 = 5 AND event_type = 'purchase'
  UNION ALL SELECT job_id, seq, ['field_' || (seq % 13)], CASE WHEN seq % 2 = 0 THEN ['field_' || (seq % 13), 'in'] ELSE ['field_' || (seq % 13)] END, CASE WHEN seq % 2 = 0 THEN k ELSE '"t' || k || '"' END FROM typed),
latest AS (SELECT job_id, path, arg_max(value, seq) AS value, max(seq) AS seq FROM given GROUP BY job_id, path),
places AS (SELECT job_id, place, max(seq) AS seq FROM given GROUP BY job_id, place),
fields AS (
  SELECT l.* FROM latest l
  WHERE NOT EXISTS (SELECT 1 FROM places p WHERE p.job_id = l.job_id AND p.seq > l.seq AND l.path[1:len(p.place)] = p.place)
    AND NOT EXISTS (SELECT 1 FROM latest m WHERE m.job_id = l.job_id AND m.seq > l.seq AND len(m.path) > len(l.path) AND m.path[1:len(l.path)] = l.path))"""


def _payload_events(spark: SparkSession, d: str) -> DataFrame:
    """Job events with a JSON object of fields to set: some named by the event, some inside of others; every 41st is broken."""
    events = b.job_events(spark, d).join(b.table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"), "seq")
    k = F.get_json_object("metrics", "$.k")
    paid = F.col("event_type") == "purchase"
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    tokens = F.when(F.col("seq") % 3 == 0, text(', "total_tokens": ', (F.col("seq") % 1000).cast("string"))).otherwise("")
    stage = F.when(paid, text('"stages.', F.col("stage"), '.metrics.paid": [', k, ", ", F.col("seq").cast("string"), "]")).otherwise(
        text('"stages.', F.col("stage"), '": {"status": ', quoted(F.col("status")), ', "metrics": {"k": ', k, tokens, "}}")
    )
    reset = F.when(paid & (F.col("seq") % 701 == 5), F.lit(', "stages": null')).otherwise("")
    name = text('"field_', (F.col("seq") % 13).cast("string"), '": ')
    own = F.when(F.col("seq") % 2 == 0, text(name, '{"in": ', k, "}")).otherwise(text(name, '"t', k, '"'))
    payload = text('{"last_', F.col("event_type"), '": ', F.col("seq").cast("string"), ", ", stage, reset, ", ", own, "}")
    return events.select("job_id", "seq", F.when(F.col("seq") % 41 == 0, F.substring(payload, 1, 9)).otherwise(payload).alias("payload"))


@query("d14_fold_any_fields", f"WITH {_SETS} SELECT job_id, array_to_string(path, '.') AS field, value, seq FROM fields")
def d14_fields(spark: SparkSession, d: str) -> DataFrame:
    fields = payloads.fold_fields(_payload_events(spark, d))
    return fields.select("job_id", F.array_join("path", ".").alias("field"), F.to_json("value").alias("value"), "seq")


@query("d9_any_job_status", f"WITH {_SETS} SELECT job_id, array_to_string(path, '.') AS field, value FROM fields WHERE NOT (len(path) > 3 AND path[1] = 'stages' AND path[2] = 'PRECHECK' AND path[3] = 'metrics') OR path[4] = 'total_tokens'")
def d9_fields(spark: SparkSession, d: str) -> DataFrame:
    """Shown fields, read back from the records they are packed in."""
    packed = payloads.records(payloads.shown_fields(payloads.fold_fields(_payload_events(spark, d))))
    fields = packed.select("job_id", F.explode(F.variant_get("record", "$", "map<string,variant>")).alias("field", "value"))
    return fields.select("job_id", "field", F.to_json("value").alias("value"))


def _gone(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    gone = spark.createDataFrame([("src1",), ("src4",)], "repo_id string")
    return docs.delete_repo(gone, b.conversations(spark, d), b.messages(spark, d), b.model_documents(spark, d), _repos(spark, d))


@query("d15_delete_repo", f"WITH {b.DOCS}, {b.CHATS} SELECT 'conversations' AS kind, count(*) AS rows FROM heads WHERE repo_id NOT IN ('src1', 'src4') UNION ALL SELECT 'messages', count(*) FROM msgs WHERE conversation_id % 20 NOT IN (1, 4) UNION ALL SELECT 'documents', count(*) FROM docs WHERE repo_id NOT IN ('src1', 'src4') UNION ALL SELECT 'ingested', count(DISTINCT folder) FROM files WHERE folder NOT IN ('src1', 'src4')")
def d15(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for kind, part in zip(("conversations", "messages", "documents", "ingested"), _gone(spark, d), strict=True):
        rows = part.agg(F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), "rows")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("d16_delete_conversations", f"WITH {b.CHATS} SELECT conversation_id, role, content FROM msgs WHERE conversation_id % 3 <> 0")
def d16(spark: SparkSession, d: str) -> DataFrame:
    heads = b.conversations(spark, d)
    return docs.delete_conversations(heads.where("conversation_id % 3 = 0"), heads, b.messages(spark, d))[1].select("conversation_id", "role", "content")


@query(
    "d17_assemble_chat",
    f"""WITH {b.CHATS}, turns AS (
  SELECT conversation_id, 0 AS pos, 'system' AS role, CASE WHEN repo_id < 'src5' THEN 'context of ' || repo_id ELSE '' END AS content FROM heads
  UNION ALL SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn), role, content FROM msgs
  UNION ALL SELECT h.conversation_id, (SELECT count(*) FROM msgs m WHERE m.conversation_id = h.conversation_id) + 1, 'user', 'and now?' FROM heads h WHERE h.conversation_id % 2 = 0)
SELECT conversation_id, CAST(pos AS INTEGER) AS pos, role, content FROM turns""",
)
def d17(spark: SparkSession, d: str) -> DataFrame:
    heads = b.conversations(spark, d)
    contexts = _repos(spark, d).where("repo_id < 'src5'").withColumn("data", F.concat(F.lit("context of "), "repo_id"))
    asked = heads.where("conversation_id % 2 = 0").select("conversation_id", F.lit("and now?").alias("content"))
    return docs.assemble_chats(heads, b.messages(spark, d), contexts, asked).select("conversation_id", F.posexplode("prompt").alias("pos", "t")).select("conversation_id", "pos", "t.role", "t.content")


@query("d18_append_turns", f"WITH {b.CHATS}, both_ AS (SELECT conversation_id, turn, role, content FROM msgs UNION ALL SELECT conversation_id, 1000000, 'assistant', 'done' FROM heads) SELECT conversation_id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS INTEGER) AS turn, role, content FROM both_")
def d18(spark: SparkSession, d: str) -> DataFrame:
    new = b.conversations(spark, d).select("conversation_id", F.lit("assistant").alias("role"), F.lit("done").alias("content"), F.timestamp_seconds(F.lit(1000000)).alias("created_at"))
    return docs.append_turns(b.messages(spark, d), new).select("conversation_id", "turn", "role", "content")


@query(
    "d19_admit_batch",
    f"""WITH {b.JOBS}, asked AS (SELECT 'b' || (n % 3) AS batch_id, n // 3 AS batch_index, 'src' || n AS repo_id FROM range(0, 24) r(n))
SELECT batch_id, CAST(batch_index AS INTEGER) AS batch_index, repo_id,
  CASE WHEN repo_id NOT IN (SELECT source FROM documents) THEN 'missing' WHEN repo_id < 'src12' THEN 'already ingested' WHEN repo_id IN (SELECT repo_name FROM jobs WHERE status = 'running') THEN 'being ingested' ELSE 'queued' END AS verdict
FROM asked""",
)
def d19(spark: SparkSession, d: str) -> DataFrame:
    rows = [(f"b{k}", [f"src{n}" for n in range(k, 24, 3)]) for k in range(3)]
    repos = _repos(spark, d)
    return docs.admit_batch(spark.createDataFrame(rows, "batch_id string, repos array<string>"), repos, repos.where("repo_id < 'src12'"), _jobs(spark, d))


@query("d20_deletable_jobs", f"WITH {b.JOBS} SELECT job_id FROM jobs WHERE status <> 'running'")
def d20(spark: SparkSession, d: str) -> DataFrame:
    return docs.deletable_jobs(_jobs(spark, d)).select("job_id")


@query("d21_abort_requested", f"WITH {b.JOBS} SELECT job_id, abort_requested, CASE WHEN abort_requested AND status = 'running' THEN 'aborted' ELSE status END AS status FROM jobs")
def d21(spark: SparkSession, d: str) -> DataFrame:
    return docs.abort_requested(_jobs(spark, d))


def _folder(spark: SparkSession, name: str) -> str:
    return new_folder(spark, name)


def _stream(spark: SparkSession, rows: DataFrame, name: str, batches: int = 3) -> DataFrame:
    """``rows`` written as files that a stream then reads in a few batches, a file for each core at a time."""
    path, cores = _folder(spark, name), spark.sparkContext.defaultParallelism
    rows.repartition(batches * cores).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", cores).parquet(path)


@query("st1_job_status_stream", f"WITH {b.JOBS} SELECT job_id, repo_name, status, current_stage, error, abort_requested, created_at, updated_at FROM jobs")
def st1(spark: SparkSession, d: str) -> DataFrame:
    folded = streams.job_status_stream(_stream(spark, b.job_events(spark, d), "st1_events"))
    out = _folder(spark, "st1_out")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    streams.run_available(folded.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", _folder(spark, "st1_check")))
    return spark.read.parquet(out).select("job_id", "repo_name", "status", "current_stage", "error", "abort_requested", "created_at", "updated_at")


@query(
    "st1_job_state_stream",
    f"""WITH {b.JOBS}, stages AS ({_stages.replace(f"WITH {b.EVENTS} ", "")})
SELECT j.job_id, j.repo_name, j.status, current_stage, j.error, batch_id, batch_index, abort_requested, created_at, updated_at, s.stage, s.status AS stage_status, s.metrics, s.error AS stage_error
FROM jobs j JOIN stages s ON j.job_id = s.job_id""",
)
def st1_state(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each job in a stream of updates, its events taken in no order."""
    out, name = _folder(spark, "st1_out"), "spark.sql.streaming.stateStore.providerClass"
    folded = streams.job_state_stream(_stream(spark, b.job_events(spark, d), "st1_events", 2))

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    before = spark.conf.get(name)
    spark.conf.set(name, streams.ROCKSDB)
    try:
        streams.run_available(folded.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", _folder(spark, "st1_check")))
    finally:
        spark.conf.set(name, before)
    rows = spark.read.parquet(out)
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*rows.columns), "batch").alias("r")).select("r.*")
    each = last.withColumn("s", F.explode("stages"))
    return each.select("job_id", "repo_name", "status", "current_stage", "error", "batch_id", "batch_index", "abort_requested", "created_at", "updated_at", "s.stage", F.col("s.status").alias("stage_status"), "s.metrics", F.col("s.error").alias("stage_error"))


@query("st2_changed_file_stream", f"WITH {b.FILES} SELECT path, sha1(CASE WHEN doc_id % 7 = 0 THEN content || 'x' ELSE content END) AS sha1 FROM files")
def st2(spark: SparkSession, d: str) -> DataFrame:
    f = b.files(spark, d)
    row = lambda text, at: (F.col("lang").alias("namespace"), "path", F.sha1(text).alias("sha1"), F.lit(at).cast("long").alias("updated_at"))
    versions = f.select(*row(F.col("content"), 1)).unionByName(f.where("doc_id % 7 = 0").select(*row(F.concat("content", F.lit("x")), 2)))
    out = _folder(spark, "st2_out")
    streams.run_available(streams.changed_file_stream(_stream(spark, versions, "st2_files"), _folder(spark, "st2_check"), out))
    return spark.read.parquet(out).groupBy("path").agg(F.max_by("sha1", "updated_at").alias("sha1"))


@query("st3_chat_append_stream", f"WITH {b.CHATS} SELECT conversation_id, turn AS created, role, content FROM msgs")
def st3(spark: SparkSession, d: str) -> DataFrame:
    out = _folder(spark, "st3_messages")
    m = b.messages(spark, d)
    turns = m.select("conversation_id", "created_at", "role", "content")
    streams.run_available(streams.chat_append_stream(_stream(spark, turns.unionByName(turns), "st3_turns"), out, _folder(spark, "st3_check")))
    return spark.read.parquet(out).select("conversation_id", F.unix_seconds("created_at").alias("created"), "role", "content")
