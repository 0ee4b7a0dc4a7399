"""Document, job and conversation queries, each over whole tables of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import config, scalars

RUNNING = ("running", "pending")
BUSY = ("running", "aborting")


def of_type(documents: DataFrame, kind: str) -> DataFrame:
    """repo_id and path of the documents of one kind that have a path."""
    return documents.where((F.col("document_type") == kind) & (F.coalesce("file_path", F.lit("")) != "")).select("repo_id", F.col("file_path").alias("path"))


def potential_entry_points(documents: DataFrame) -> DataFrame:
    """D1"""
    return of_type(documents, config.ENTRY_POINTS)


def repo_summaries(repos: DataFrame, documents: DataFrame) -> DataFrame:
    """The summary of each repository, or an empty text."""
    found = documents.where(F.col("document_type") == config.SUMMARY).groupBy("repo_id").agg(F.max("data").alias("_data"))
    return repos.select("repo_id").join(found, "repo_id", "left").select("repo_id", F.coalesce("_data", F.lit("")).alias("summary"))


def briefs_in_order(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """D3: repo_id, pos, path and brief for requests (repo_id, paths array), in the array's order; empty briefs go.

    Requests of any length are rows (repo_id, pos, path).
    """
    briefs = documents.where((F.col("document_type") == config.BRIEF) & (F.col("data") != "")).select("repo_id", F.col("file_path").alias("path"), F.col("data").alias("brief"))
    asked = requests.select("repo_id", F.posexplode("paths").alias("pos", "path")) if "paths" in requests.columns else requests
    return asked.join(briefs, ["repo_id", "path"]).select("repo_id", "pos", "path", "brief")


def brief_or_empty(keys: DataFrame, documents: DataFrame) -> DataFrame:
    """The brief of each (repo_id, path), or an empty text."""
    briefs = documents.where(F.col("document_type") == config.BRIEF).groupBy("repo_id", F.col("file_path").alias("path")).agg(F.max("data").alias("_data"))
    return keys.join(briefs, ["repo_id", "path"], "left").select("repo_id", "path", F.coalesce("_data", F.lit("")).alias("brief"))


def critical_paths(documents: DataFrame) -> DataFrame:
    """D5"""
    return of_type(documents, config.BRIEF)


def clamped(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def list_conversations(conversations: DataFrame, repo_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Latest first; limit within 1 to 200, offset at least 0."""
    rows = conversations if repo_id is None else conversations.where(F.col("repo_id") == repo_id)
    return rows.orderBy(F.desc("updated_at"), "conversation_id").offset(max(0, offset)).limit(clamped(limit, 1, 200))


def list_messages(messages: DataFrame, conversation_id: int | str, limit: int = 200) -> DataFrame:
    """Oldest first, those of one time by role and content; limit within 1 to 500."""
    return messages.where(F.col("conversation_id") == conversation_id).orderBy("created_at", "role", "content").limit(clamped(limit, 1, 500))


def first_messages(messages: DataFrame, conversations: DataFrame, limit: int = 200) -> DataFrame:
    """D7 for all existing conversations at once."""
    order = Window.partitionBy("conversation_id").orderBy("created_at", "role", "content")
    rows = messages.join(conversations.select("conversation_id"), "conversation_id", "left_semi")
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= clamped(limit, 1, 500))


def list_jobs(jobs: DataFrame, limit: int = 50, skip: int = 0, **equal: str) -> DataFrame:
    """Jobs that match all filters given, latest update first."""
    rows = jobs
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("updated_at"), F.desc("created_at"), "job_id").offset(skip).limit(limit)


def count_jobs(jobs: DataFrame, **equal: str) -> DataFrame:
    rows = jobs
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.agg(F.count("*").alias("total"))


def job_statuses(jobs: DataFrame, names: Sequence[str] = config.PRECHECK_METRICS, stage: str = "PRECHECK") -> DataFrame:
    """Jobs with only the listed metrics in the precheck stage of ``stages`` (map to struct with ``metrics`` map)."""
    shown = F.transform_values("stages", lambda k, v: F.when(k == stage, v.withField("metrics", scalars.whitelist(v["metrics"], names))).otherwise(v))
    return jobs.withColumn("stages", shown)


def batch_jobs(jobs: DataFrame, batch_id: str) -> DataFrame:
    """D10"""
    return jobs.where(F.col("batch_id") == batch_id).orderBy("batch_index")


def repo_states(repos: DataFrame, ingested: DataFrame, jobs: DataFrame, running: Sequence[str] = RUNNING) -> DataFrame:
    """Whether each repository is ingested and whether it is being so."""
    done = ingested.select("repo_id").distinct().withColumn("_done", F.lit(True))
    busy = jobs.where(F.col("status").isin(*running)).select(F.col("repo_name").alias("repo_id")).distinct().withColumn("_busy", F.lit(True))
    no = F.lit(False)
    return repos.select("repo_id").join(done, "repo_id", "left").join(busy, "repo_id", "left").select("repo_id", F.coalesce("_done", no).alias("ingested"), F.coalesce("_busy", no).alias("being_ingested"))


def ingested_repos(ingested: DataFrame) -> DataFrame:
    """D12"""
    return ingested.where(F.coalesce("repo_id", F.lit("")) != "").select("repo_id")


def add_ingested(ingested: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of repositories that weren't there."""
    return ingested.unionByName(new.join(ingested.select("repo_id"), "repo_id", "left_anti").select(*ingested.columns))


def _last(column: str) -> Column:
    """The value of the latest event that gives one."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)


def fold_jobs(events: DataFrame) -> DataFrame:
    """One row a job of events (job_id, seq, ts, repo_name, status, stage, metrics, error, batch_id, batch_index, abort).

    Latest status and stage; created_at of the first event, updated_at of the last;
    error and batch only change where an event gives them; an abort asked for once
    stays.
    """
    return events.groupBy("job_id").agg(
        *(_last(c) for c in ("repo_name", "status")),
        _last("stage").alias("current_stage"),
        *(_last(c) for c in ("error", "batch_id", "batch_index")),
        F.coalesce(F.bool_or("abort"), F.lit(False)).alias("abort_requested"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


def fold_stages(events: DataFrame) -> DataFrame:
    """job_id, stage and the latest status, metrics and error of each stage."""
    return events.where("stage IS NOT NULL").groupBy("job_id", "stage").agg(_last("status"), _last("metrics"), _last("error"))


def with_stages(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """Jobs with ``stages`` as a map; a job has few stages."""
    packed = stages.groupBy("job_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", F.struct("status", "metrics", "error").alias("state"))))).alias("stages"))
    return jobs.join(packed, "job_id", "left")


def delete_repo(gone: DataFrame, conversations: DataFrame, messages: DataFrame, documents: DataFrame, ingested: DataFrame) -> tuple[DataFrame, ...]:
    """The four tables without the repositories ``gone`` (repo_id); messages go with their conversations."""
    ids = gone.select("repo_id")
    lost = conversations.join(ids, "repo_id", "left_semi").select("conversation_id")
    return (
        conversations.join(ids, "repo_id", "left_anti").select(*conversations.columns),
        messages.join(lost, "conversation_id", "left_anti").select(*messages.columns),
        documents.join(ids, "repo_id", "left_anti").select(*documents.columns),
        ingested.join(ids, "repo_id", "left_anti").select(*ingested.columns),
    )


def delete_conversations(gone: DataFrame, conversations: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D16"""
    ids = gone.select("conversation_id")
    return conversations.join(ids, "conversation_id", "left_anti").select(*conversations.columns), messages.join(ids, "conversation_id", "left_anti").select(*messages.columns)


def assemble_chats(conversations: DataFrame, messages: DataFrame, contexts: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """conversation_id and ``prompt``, an array of (role, content).

    The repository's context as system turn (empty where there is none), the
    history in time order, and the new user turn (conversation_id, content) if given.
    """
    turn = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    history = messages.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "role", "content"))).alias("_history"))  # a conversation's turns are one prompt
    rows = conversations.select("conversation_id", "repo_id").join(contexts.select("repo_id", F.col("data").alias("_context")), "repo_id", "left").join(history, "conversation_id", "left")
    system = F.array(turn(F.lit("system"), F.coalesce("_context", F.lit(""))))
    past = F.transform(F.coalesce("_history", F.array().cast("array<struct<created_at:timestamp,role:string,content:string>>")), lambda s: turn(s["role"], s["content"]))
    if turns is None:
        return rows.select("conversation_id", F.concat(system, past).alias("prompt"))
    asked = turns.select("conversation_id", F.col("content").alias("_asked"))
    new = F.array_compact(F.array(F.when(F.col("_asked").isNotNull(), turn(F.lit("user"), F.col("_asked")))))
    return rows.join(asked, "conversation_id", "left").select("conversation_id", F.concat(system, past, new).alias("prompt"))


def append_turns(messages: DataFrame, new: DataFrame) -> DataFrame:
    """All messages, numbered from 1 within their conversation by time."""
    order = Window.partitionBy("conversation_id").orderBy("created_at", "role", "content")
    return messages.unionByName(new).withColumn("turn", F.row_number().over(order))


def admit_batch(requested: DataFrame, present: DataFrame, ingested: DataFrame, jobs: DataFrame, running: Sequence[str] = RUNNING) -> DataFrame:
    """batch_id, batch_index, repo_id and verdict of requests (batch_id, repos array)."""
    rows = requested.select("batch_id", F.posexplode("repos").alias("batch_index", "repo_id"))
    known = present.select("repo_id").distinct().withColumn("_present", F.lit(True))
    states = repo_states(rows.select("repo_id").distinct(), ingested, jobs, running)
    verdict = F.when(F.col("_present").isNull(), "missing").when(F.col("ingested"), "already ingested").when(F.col("being_ingested"), "being ingested").otherwise("queued")
    return rows.join(known, "repo_id", "left").join(states, "repo_id").select("batch_id", "batch_index", "repo_id", verdict.alias("verdict"))


def deletable_jobs(jobs: DataFrame, busy: Sequence[str] = BUSY) -> DataFrame:
    """Jobs that are not at work."""
    return jobs.where(~F.coalesce(F.col("status").isin(*busy), F.lit(False)))


def abort_requested(jobs: DataFrame) -> DataFrame:
    """Whether an abort was asked for, and the status a stage that sees it takes."""
    return jobs.select("job_id", "abort_requested", F.when(F.col("abort_requested") & F.col("status").isin(*RUNNING), "aborted").otherwise(F.col("status")).alias("status"))
