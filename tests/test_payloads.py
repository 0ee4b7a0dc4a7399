"""Payloads of any fields, against a plain loop over events."""

import json
import random

from pyspark.sql import functions as F

from cartolith.operators import payloads

SCHEMA = "job_id string, seq long, payload string"


def loop(events, levels=payloads.LEVELS):
    """Records as dicts of leaves, one event after the other."""
    records = {}

    def apart(path, value, left):
        if left and isinstance(value, dict) and value:
            for k, v in value.items():
                yield from apart((*path, k), v, left - 1)
        else:
            yield path, value

    for job, seq, payload in sorted((e for e in events if e[2]), key=lambda e: e[1]):
        try:
            fields = json.loads(payload)
        except ValueError:
            continue
        if not isinstance(fields, dict) or not fields:
            continue
        record = records.setdefault(job, {})
        for name, value in fields.items():
            place = tuple(name.split("."))
            new = dict(apart(place, value, levels))
            for path in list(record):
                under = path[: len(place)] == place
                above = any(len(n) > len(path) and n[: len(path)] == path for n in new)
                if (under or above) and record[path][1] < seq:
                    del record[path]
            record.update({path: (value, seq) for path, value in new.items()})
    return {job: {".".join(p): v for p, (v, _) in r.items()} for job, r in records.items() if r}


def fold(spark, events, **kind):
    rows = payloads.fold_fields(spark.createDataFrame(events, SCHEMA), **kind).select("job_id", F.array_join("path", ".").alias("f"), F.to_json("value").alias("v")).collect()
    out = {}
    for job, f, v in rows:
        assert f not in out.setdefault(job, {})
        out[job][f] = json.loads(v)
    return out


def test_random_events_equal_a_loop(spark):
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(7)
        if kind < 3 and depth:
            return {rng.choice("xyz"): value(depth - 1) for _ in range(rng.randrange(3))}
        return [rng.randrange(9), "t", None, [1, {"x": 2}], True][kind % 5]

    events = []
    for seq in range(600):
        name = ".".join(rng.choice("ab") for _ in range(rng.choice((1, 1, 2, 3))))
        payload = json.dumps({name: value(3)})
        events.append((rng.choice(("j1", "j2", "j3", None)), seq, rng.choice((payload, payload, payload, "{", "[1]", "{}", None))))
    rng.shuffle(events)
    got, want = fold(spark, events), loop(events)
    assert got == want and None in got


def test_unseen_fields_and_nested_places(spark):
    events = [
        ("j", 1, '{"owner": "a", "stages.PRECHECK": {"status": "running", "metrics": {"total_tokens": 3, "secret": 1}}}'),
        ("j", 2, '{"stages.PRECHECK.metrics.total_tokens": 4, "note": null}'),
        ("j", 3, '{"owner": {"name": "b"}}'),
        ("k", 1, '{"stages": {"PRECHECK": 1}}'),
        ("k", 2, '{"stages": "gone"}'),
    ]
    assert fold(spark, events) == {
        "j": {"owner.name": "b", "note": None, "stages.PRECHECK.status": "running", "stages.PRECHECK.metrics.total_tokens": 4, "stages.PRECHECK.metrics.secret": 1},
        "k": {"stages": "gone"},
    }
    record = payloads.records(payloads.shown_fields(payloads.fold_fields(spark.createDataFrame(events, SCHEMA)))).where("job_id = 'j'").select(F.to_json("record")).first()[0]
    assert json.loads(record) == {"owner.name": "b", "note": None, "stages.PRECHECK.status": "running", "stages.PRECHECK.metrics.total_tokens": 4}


def test_levels_and_equal_order(spark):
    deep = [("j", 1, '{"a": {"b": {"c": 1}}}'), ("j", 2, '{"a.b": {"d": 2}}')]
    assert fold(spark, deep, levels=1) == {"j": {"a.b.d": 2}}
    assert fold(spark, deep[:1], levels=1) == {"j": {"a.b": {"c": 1}}}
    twice = [("j", 1, '{"a": 1}'), ("j", 1, '{"a": 2}'), ("j", 1, '{"a": 2}')]
    assert fold(spark, twice) == {"j": {"a": 2}}


def test_no_events(spark):
    assert fold(spark, []) == {}
    assert payloads.records(payloads.fold_fields(spark.createDataFrame([], SCHEMA))).count() == 0


def test_no_join_without_keys(spark):
    plan = payloads.fold_fields(spark.createDataFrame([("j", 1, '{"a": 1}')], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
