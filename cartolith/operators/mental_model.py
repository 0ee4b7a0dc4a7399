"""Criticality, summaries and entry points of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import config, scalars
from ..sources.files import upsert

DOC_KEYS = ("repo_id", "file_path", "document_type")


def split_cached(files: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M1: files (repo_id, path) with a summary already, and those without."""
    done = documents.where(F.col("document_type").isin(config.BRIEF, config.IGNORED)).select("repo_id", F.col("file_path").alias("path")).distinct()
    return files.join(done, ["repo_id", "path"], "left_semi"), files.join(done, ["repo_id", "path"], "left_anti")


def summarise(prompts: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """repo_id, path and the trimmed ``result`` of ``fn`` for each prompt (repo_id, path, prompt), partition by partition."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"repo_id": pdf["repo_id"], "path": pdf["path"], "result": [fn(p).strip() for p in pdf["prompt"]]})

    return prompts.select("repo_id", "path", "prompt").mapInPandas(each, "repo_id string, path string, result string")


def degree(edges: DataFrame) -> DataFrame:
    """In- and out-degree of every file of ``edges`` (src, dst)."""
    ends = edges.select(F.col("src").alias("path"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("path").agg(F.sum("in").alias("in_degree"), F.sum("out").alias("out_degree"))


def measured(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``files`` with the ``tokens`` of their texts and whether those are ``blank``, in place of the texts, which no join has to move then."""
    blank = ~F.coalesce(F.col(content).rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    return files.select(*(c for c in files.columns if c != content), scalars.count_tokens(F.col(content)).alias("tokens"), blank.alias("blank"))


def template(path: str = "path") -> Column:
    """The default description, from what the whole text measures and the degrees; of a blank text it is empty."""
    numbers = F.col("tokens"), F.col("out_degree"), F.col("in_degree")
    told = F.concat(path, F.lit(": "), numbers[0].cast("string"), F.lit(" tokens, uses "), numbers[1].cast("string"), F.lit(", used by "), numbers[2].cast("string"))
    return F.when(F.col("blank"), F.lit("")).otherwise(told)


def default_summary(files: DataFrame, edges: DataFrame, text: Column | None = None) -> DataFrame:
    """M2 without a function: files with a dependency either way are critical and described by ``text``, others ``IGNORE``.

    What the default ``text`` tells of a content is measured before the join with the degrees, so no content is shuffled.
    """
    described = template() if text is None else text
    known = measured(files.select("repo_id", "path", "content")) if text is None else files
    joined = known.join(degree(edges), "path", "left")
    critical = F.coalesce(F.col("in_degree") + F.col("out_degree"), F.lit(0)) > 0
    return joined.select("repo_id", "path", F.when(critical, described).otherwise(F.lit("IGNORE")).alias("result"))


def classify_results(results: DataFrame) -> DataFrame:
    """M3: documents of the results; only an exact ``IGNORE``, trimmed, is ignored."""
    text = F.regexp_replace("result", r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    return results.select("repo_id", F.col("path").alias("file_path"), F.when(text == "IGNORE", config.IGNORED).otherwise(config.BRIEF).alias("document_type"), text.alias("data"))


def store_documents(documents: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    return upsert(documents, new, DOC_KEYS, version)


def critical_files(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("document_type") == config.BRIEF).select("repo_id", F.col("file_path").alias("path"), F.col("data").alias("brief"))


def enrich(critical: DataFrame, edges: DataFrame, downstream_flat: DataFrame, upstream_flat: DataFrame) -> DataFrame:
    """M4: critical files with their dependency files and interaction texts, empty where there are none; a row holds all that refers to its file."""
    none = F.array().cast("array<string>")
    uses = edges.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_set("dst")).alias("downstream_files"))
    used = edges.groupBy(F.col("dst").alias("path")).agg(F.sort_array(F.collect_set("src")).alias("upstream_files"))
    texts = downstream_flat.withColumnRenamed("interactions", "downstream_interactions"), upstream_flat.withColumnRenamed("interactions", "upstream_interactions")
    out = critical
    for part in (uses, used, *texts):
        out = out.join(part, "path", "left")
    names = ("downstream_files", "upstream_files", "downstream_interactions", "upstream_interactions")
    return out.select(*critical.columns, *(F.coalesce(c, none).alias(c) for c in names))


def enrich_rows(critical: DataFrame, edges: DataFrame, downstream_texts: DataFrame, upstream_texts: DataFrame) -> DataFrame:
    """M4 as rows path, insight (the column of ``enrich``) and value, for files that any number of others use."""
    named = lambda rows, path, insight, value: rows.select(F.col(path).alias("path"), F.lit(insight).alias("insight"), F.col(value).alias("value"))
    all_ = named(edges, "src", "downstream_files", "dst").unionByName(named(edges, "dst", "upstream_files", "src"))
    all_ = all_.unionByName(named(downstream_texts, "path", "downstream_interactions", "text")).unionByName(named(upstream_texts, "path", "upstream_interactions", "text"))
    return all_.distinct().join(critical.select("path"), "path", "left_semi")


def entry_points(critical: DataFrame, edges: DataFrame) -> DataFrame:
    """M5: critical files that no other critical file uses."""
    used = edges.where("src <> dst").join(critical.select(F.col("path").alias("src")), "src", "left_semi").select(F.col("dst").alias("path"))
    return critical.join(used, "path", "left_anti").select(*critical.columns)


def counts(documents: DataFrame) -> DataFrame:
    """Critical and ignored files of each repository."""
    return documents.groupBy("repo_id").agg(F.count_if(F.col("document_type") == config.BRIEF).alias("critical"), F.count_if(F.col("document_type") == config.IGNORED).alias("ignored"))
