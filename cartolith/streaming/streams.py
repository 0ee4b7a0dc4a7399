"""Streaming twins of the job fold, change detection and chat append."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import documents


def job_status_stream(events: DataFrame) -> DataFrame:
    """ST1: ``fold_jobs`` over a stream of events; one state row a job, for output mode update or complete."""
    return documents.fold_jobs(events)


_FIELDS = {"repo_name": "string", "status": "string", "stage": "string", "error": "string", "batch_id": "string", "batch_index": "int"}
_STAGE_FIELDS = ("status", "metrics", "error")
JOB = "job_id string, repo_name string, status string, current_stage string, error string, batch_id string, batch_index int, abort_requested boolean, created_at long, updated_at long, stages array<struct<stage:string,status:string,metrics:string,error:string>>, stalled boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobFold(StatefulProcessor):
    """State of one job: each field's latest value with its seq, and a map of its stages; a timer for jobs that nothing is heard of.

    An event only replaces what has a lower seq, so batches may come in any order.
    """

    def __init__(self, stall_ms: int | None, running: Sequence[str]):
        self.stall_ms, self.running = stall_ms, set(running)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ", ".join(f"{c} {t}, {c}_seq long" for c, t in _FIELDS.items())
        self.job = handle.getValueState("job", f"{columns}, abort boolean, created_at long, updated_at long, due long")
        self.stages = handle.getMapState("stages", "stage string", ", ".join(f"{c} string, {c}_seq long" for c in _STAGE_FIELDS))

    @staticmethod
    def _later(held: dict, event: dict, names: Iterable[str]) -> None:
        for c in names:
            if event[c] is not None and (held[f"{c}_seq"] is None or event["seq"] > held[f"{c}_seq"]):
                held[c], held[f"{c}_seq"] = event[c], event["seq"]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job_names = [x for c in _FIELDS for x in (c, f"{c}_seq")] + ["abort", "created_at", "updated_at", "due"]
        stage_names = [x for c in _STAGE_FIELDS for x in (c, f"{c}_seq")]
        job = dict(zip(job_names, self.job.get() if self.job.exists() else [None] * len(job_names), strict=True))
        stages = {k[0]: dict(zip(stage_names, v, strict=True)) for k, v in self.stages.iterator()}
        touched = set()
        for pdf in rows:
            for event in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                event["batch_index"] = None if event["batch_index"] is None else int(event["batch_index"])  # a column with gaps holds floats
                self._later(job, event, _FIELDS)
                job["abort"] = bool(job["abort"] or event["abort"])
                job["created_at"] = event["ts"] if job["created_at"] is None else min(job["created_at"], event["ts"])
                job["updated_at"] = event["ts"] if job["updated_at"] is None else max(job["updated_at"], event["ts"])
                if event["stage"] is not None:
                    touched.add(event["stage"])
                    self._later(stages.setdefault(event["stage"], dict.fromkeys(stage_names)), event, _STAGE_FIELDS)
        for stage in touched:
            self.stages.updateValue((stage,), tuple(_plain(stages[stage][c]) for c in stage_names))
        if self.stall_ms is not None:
            if job["due"] is not None:
                self.handle.deleteTimer(int(job["due"]))
            job["due"] = timerValues.getCurrentProcessingTimeInMs() + self.stall_ms if job["status"] in self.running else None
            if job["due"] is not None:
                self.handle.registerTimer(int(job["due"]))
        self.job.update(tuple(_plain(job[c]) for c in job_names))
        yield self._row(key, job, stages, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job_names = [x for c in _FIELDS for x in (c, f"{c}_seq")] + ["abort", "created_at", "updated_at", "due"]
        stage_names = [x for c in _STAGE_FIELDS for x in (c, f"{c}_seq")]
        job = dict(zip(job_names, self.job.get(), strict=True))
        stages = {k[0]: dict(zip(stage_names, v, strict=True)) for k, v in self.stages.iterator()}
        job["due"] = None
        self.job.update(tuple(_plain(job[c]) for c in job_names))
        yield self._row(key, job, stages, True)

    def _row(self, key: tuple, job: dict, stages: dict[str, dict], stalled: bool) -> pd.DataFrame:
        listed = [{"stage": s, **{c: stages[s][c] for c in _STAGE_FIELDS}} for s in sorted(stages)]
        row = {"job_id": key[0], **{("current_stage" if c == "stage" else c): job[c] for c in _FIELDS}, "abort_requested": bool(job["abort"]), "created_at": job["created_at"], "updated_at": job["updated_at"], "stages": listed, "stalled": stalled}
        return pd.DataFrame([row]).astype({"batch_index": "Int32"})

    def close(self) -> None:
        pass


def _plain(value):
    return value.item() if hasattr(value, "item") else value


def job_state_stream(events: DataFrame, stall_ms: int | None = None, running: Sequence[str] = documents.RUNNING) -> DataFrame:
    """ST1 with state of its own: of each batch the jobs that it changed, as ``fold_jobs`` and ``fold_stages`` give them, for output mode update.

    With ``stall_ms`` a job whose status is among ``running`` and that no event
    arrives for in that time comes once more, ``stalled``; a later event starts anew.
    State is kept by key, so a batch costs what it holds; the session has to use the
    state store ``ROCKSDB``.
    """
    columns = ["job_id", "seq", "ts", "abort", "metrics", *_FIELDS]
    return events.select(*columns).groupBy("job_id").transformWithStateInPandas(JobFold(stall_ms, running), JOB, "Update", "None" if stall_ms is None else "ProcessingTime")


def stage_status_stream(events: DataFrame) -> DataFrame:
    """ST1: ``fold_stages`` over a stream of events; one state row a job and stage."""
    return documents.fold_stages(events)


_VERSION = ("namespace", "path", "sha1", "updated_at")


def changed_versions(versions: DataFrame, buckets: int = 4096) -> DataFrame:
    """ST2: of file versions (namespace, path, sha1, updated_at) those whose sha1 is new for their file or differs from the last.

    The last sha1 and time of each file are the state, kept in ``buckets`` of files, for
    each call costs far more than a row; a batch costs the buckets that its files are in.
    Of several versions in one batch the latest counts; one older than the state changes
    nothing. A stream can only go on with the number of buckets it began with.
    """

    def latest(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(n, p): (s, t) for n, p, s, t in zip(*state.get, strict=True)} if state.exists else {}
        new: dict[tuple, tuple] = {}
        for pdf in batches:
            for n, p, s, t in zip(*(pdf[c] for c in _VERSION), strict=True):
                new[n, p] = max(new.get((n, p), (int(t), s)), (int(t), s))
        changed, moved = [], False
        for file, (at, sha1) in new.items():
            before = held.get(file, (None, at))
            if at >= before[1]:
                held[file], moved = (sha1, at), True
                if sha1 != before[0]:
                    changed.append((*file, sha1, at))
        if moved:
            state.update(tuple(map(list, zip(*((*file, *last) for file, last in held.items()), strict=True))))
        if changed:
            yield pd.DataFrame(changed, columns=_VERSION)

    kind = "namespace string, path string, sha1 string, updated_at long"
    held = "namespace array<string>, path array<string>, sha1 array<string>, updated_at array<long>"
    grouped = versions.select(F.pmod(F.xxhash64("namespace", "path"), F.lit(buckets)).alias("_bucket"), *_VERSION).groupBy("_bucket")
    return grouped.applyInPandasWithState(latest, kind, held, "append", GroupStateTimeout.NoTimeout)


def changed_file_stream(versions: DataFrame, checkpoint: str, out: str) -> DataStreamWriter:
    """ST2: appends changed versions to the Parquet folder ``out``; the latest row of each file there is the file's state."""
    return changed_versions(versions).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)


def chat_append_stream(turns: DataFrame, messages: str, checkpoint: str, late: str | None = None) -> DataStreamWriter:
    """ST3: appends new turns (conversation_id, created_at, role, content) to the Parquet folder ``messages``, each key's first one.

    Keys seen are state; with ``late`` (an interval) those older than that are forgotten.
    """
    keys = ["conversation_id", "created_at", "role"]
    new = turns.dropDuplicates(keys) if late is None else turns.withWatermark("created_at", late).dropDuplicatesWithinWatermark(keys)
    return new.writeStream.outputMode("append").format("parquet").option("path", messages).option("checkpointLocation", checkpoint)


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Everything that is there now, then stops."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
